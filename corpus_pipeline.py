"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Every stage works on all that its predecessor kept, as written to Parquet and read again, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitlens.llm.classifier import fit, keep_good
from orbitlens.llm.common import discard, saved, scratch, table
from orbitlens.llm.decontaminate import drop_contaminated
from orbitlens.llm.jaccard import keep_one
from orbitlens.llm.packing import pack_documents
from orbitlens.llm.secrets import redact_secrets


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that score below the threshold of a network trained on the labels."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: groups share 0.8 or more of their 5-word shingles along a chain of links."""
    return keep_one(docs, 5, 80, 100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]

#: Neither the network nor the tokenizer can be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written, and its predecessor's and its own scratch tables go then."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as own:
            docs = own.keep(saved(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
