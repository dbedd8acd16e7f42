"""URL filter: host and path rules first, then a weighted vocabulary that an Aho-Corasick automaton counts.

A term counts where the characters on both sides are no ASCII letters or digits (or the url's ends), once however often it stands there.  A url that no rule decides is
blocked if its terms weigh 1 or more together: a strict term weighs that much alone, a soft one a share of it.  Urls are matched with A-Z lower-cased.

Host, path and rules are column expressions; only the automaton runs in Python.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed by the contract: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
STRICT = ("casino", "escort", "hentai", "porn", "porno", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "betting", "cams", "dating", "gambling", "lottery", "mature", "nude", "payday", "pills", "poker", "sexy", "slots", "torrent")
#: Distinct soft terms that block.
SOFT_LIMIT = 2
#: A small vocabulary of this module's own; `read_vocabulary` takes any other.
VOCABULARY = dict.fromkeys(STRICT, 1.0) | dict.fromkeys(SOFT, 1 / SOFT_LIMIT)
#: Terms of a vocabulary that is sent to all tasks, at most.
MOST_TERMS = 1_000_000
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, float]:
    """The terms and weights of a CSV file (term, weight; a header line), A-Z lower-cased; of repeated terms the heaviest counts, null or empty terms and weights that are null or not above 0 do not.

    More than MOST_TERMS terms raise ValueError: the automaton is a broadcast.
    """
    rows = spark.read.schema("term string, weight double").option("header", True).csv(path)
    rows = rows.select(lowered(F.trim("term")).alias("term"), "weight").where("term <> '' AND weight > 0 AND NOT isnan(weight)")
    out = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(out) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    return {r["term"]: r["weight"] for r in out}


def lowered(x: Column) -> Column:
    return F.translate(x, _AZ, _AZ.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract defines them; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule (host and path together; of equal ones that with the longer host) that fits, and its verdict; null without one."""
    rule = verdict = F
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (rule.otherwise(none), verdict.otherwise(none)) if rules else (none, none)


def _automaton(vocabulary: Mapping[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for x, weight in vocabulary.items():
        out.add_word(x, (x, weight))
    out.make_automaton()
    return out


def _alone(text: str, begin: int, end: int) -> bool:
    sides = (text[begin - 1] if begin else "", text[end] if end < len(text) else "")
    return not any(c.isascii() and c.isalnum() for c in sides if c)


def terms_of(url: str, automaton) -> set[tuple[str, float]]:
    """Distinct terms, with their weights, that stand alone in the lower-cased url."""
    return {hit for end, hit in automaton.iter(url) if _alone(url, end - len(hit[0]) + 1, end + 1)}


def _count(batches, vocabulary):
    automaton = _automaton(vocabulary)
    for batch in batches:
        strict, soft, weight = [], [], []
        for url in batch.column(batch.num_columns - 1).to_pylist():
            found = [w for _, w in terms_of(url, automaton)]
            strict.append(sum(w >= 1 for w in found))
            soft.append(len(found) - strict[-1])
            weight.append(math.fsum(found))
        extra = [pa.array(strict, pa.int32()), pa.array(soft, pa.int32()), pa.array(weight, pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], "strict_terms", "soft_terms", "weight"])


def filter_urls(pages: DataFrame, rules=RULES, vocabulary: Mapping[str, float] = VOCABULARY) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms) for every row of `pages` (page_id, url).

    A null url has an empty host and path, no rule, no terms and is allowed.  Without rules or with an empty vocabulary those decide nothing.
    Null page_ids and repeated rows stay as they are; an empty table gives no rows.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), tuple(rules))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), lowered(F.col("url")).alias("low"))
    if vocabulary:
        rows = rows.mapInArrow(functools.partial(_count, vocabulary=dict(vocabulary)), "page_id long, host string, path string, rule string, ruled string, strict_terms int, soft_terms int, weight double")
    else:
        rows = rows.drop("low").withColumns({"strict_terms": F.lit(0), "soft_terms": F.lit(0), "weight": F.lit(0.0)})
    judged = F.coalesce("ruled", F.when(F.col("weight") >= 1 - 1e-9, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", judged.alias("verdict"), "strict_terms", "soft_terms")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql_terms(terms) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


ORACLE = rf"""
WITH a AS (SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path,
  translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
b AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, ({_sql_terms(STRICT)})::INT AS strict_terms, ({_sql_terms(SOFT)})::INT AS soft_terms FROM a),
r(rh, rp, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (SELECT b.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM b LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN strict_terms > 0 OR soft_terms >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, strict_terms, soft_terms FROM m WHERE k = 1
"""
