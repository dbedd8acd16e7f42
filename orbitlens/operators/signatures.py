"""Similarity of change signatures: weighted distance, top-k, upsert and the store's newest entries."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ARCHETYPES, NAMED_DIMENSIONS, SETTINGS, SIGNATURE_NAMES, SIGNATURE_WEIGHTS, Settings
from ..functions.indices import index

STORE_CAP = 200
#: A signature as the store keeps it; seq grows with every analysis.
RECORD = "key string, seq long, label string, lon double, lat double, period string, mode string, vector array<double>, headline string, area_ha double"
#: Bytes of vectors in a block of queries that is sent to all tasks, and pool rows that a task compares at a time.
QUERY_BYTES, ROWS = 4 << 20, 2048
#: What the signatures that come with the package show.
ARCHETYPE_HEADLINES = {
    "ref-periurban-sprawl": "Built-up land spreads over a farming fringe in many middling patches while plants thin out.",
    "ref-planned-township": "Few very large built-up blocks with sharp edges appear at once.",
    "ref-reservoir-drawdown": "The water's edge draws back evenly and leaves one large ring of bare shore.",
    "ref-forest-clearing": "Compact clearings open inside dense forest.",
    "ref-flood-inundation": "Water spreads widely over low ground in irregular shapes.",
}


def archetypes(spark: SparkSession) -> DataFrame:
    """The signatures (RECORD) that come with the package, oldest of all."""
    rows = [(k, i - len(ARCHETYPES), label, lon, lat, "reference", m, list(v), ARCHETYPE_HEADLINES[k], 0.0) for i, (k, label, lon, lat, m, v) in enumerate(ARCHETYPES)]
    return spark.createDataFrame(rows, RECORD)


def distance(a: Column, b: Column) -> Column:
    weights = F.array(*(F.lit(w) for w in SIGNATURE_WEIGHTS))
    squares = F.transform(F.arrays_zip(F.zip_with(a, b, lambda x, y: x - y).alias("d"), weights.alias("w")), lambda x: F.pow(x["d"] * x["w"], 2))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _usable(signatures: DataFrame) -> DataFrame:
    """Keys and vectors of the signatures whose vector has all dimensions."""
    whole = F.col("key").isNotNull() & (F.size("vector") == len(SIGNATURE_WEIGHTS)) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return signatures.where(whole).select("key", F.col("vector").cast("array<double>").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), len(SIGNATURE_WEIGHTS))


def _nearest(batches, keys: list[str], queries: np.ndarray, k: int):
    """Of a task's pool the k nearest for each query, ties (to nine digits) to the smaller key."""
    weights = np.array(SIGNATURE_WEIGHTS)
    best: list[list] = [[] for _ in keys]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            names = part.column(0).to_pylist()
            x = _matrix(part.column(1))
            for i, q in enumerate(queries):
                d = np.sqrt((((q - x) * weights) ** 2).sum(1))
                near = np.flatnonzero(d <= (np.partition(d, k)[k] if len(d) > k + 1 else np.inf) + 1e-8)
                own = best[i] + [(round(float(d[j]), 9), names[j], float(d[j])) for j in near if names[j] != keys[i]]
                best[i] = sorted(own)[:k]
    rows = [(keys[i], name, d) for i, own in enumerate(best) for _, name, d in own]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["query_key", "key", "distance"])


def _blocks(queries: DataFrame):
    keys, vectors = [], []
    for row in queries.toLocalIterator():
        keys.append(row["key"])
        vectors.append(row["vector"])
        if 8 * len(SIGNATURE_WEIGHTS) * len(keys) >= QUERY_BYTES:
            yield keys, np.array(vectors)
            keys, vectors = [], []
    if keys:
        yield keys, np.array(vectors)


def most_similar(queries: DataFrame, pool: DataFrame, k: int = 4) -> DataFrame:
    """(query_key, key, rank, distance, similarity): the k nearest signatures of the pool for every query, never itself; ties by key.

    Queries go in blocks of bounded size to where the pool lies; only each task's k nearest are shuffled.  Signatures without a key or a whole vector take no part;
    of several queries with one key one counts.
    """
    pool, out = _usable(pool), None
    for keys, vectors in _blocks(_usable(queries).dropDuplicates(["key"])):
        part = pool.mapInArrow(functools.partial(_nearest, keys=keys, queries=vectors, k=k), "query_key string, key string, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = pool.sparkSession.createDataFrame([], "query_key string, key string, distance double")
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.round("distance", 9), "key"))
    rows = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select("query_key", "key", "rank", "distance", (1 / (1 + F.col("distance"))).alias("similarity"))


def matches(vector: Column, pool: DataFrame, k: int = 4) -> DataFrame:
    """The k records of the pool most like one vector, as a response lists them: by similarity to four digits, older ones first among equals."""
    whole = F.size("vector") == len(SIGNATURE_WEIGHTS)
    rows = pool.where(whole).withColumn("d", distance(vector, F.col("vector")))
    rows = rows.withColumns({"similarity": F.bround(1 / (1 + F.col("d")), 4), "similarity_percent": F.bround(100 / (1 + F.col("d"))).cast("int"), "distance": F.bround("d", 4), "why": explain(vector, F.col("vector")), "is_reference": F.col("key").startswith("ref-")})
    return rows.orderBy(F.desc("similarity"), "seq").limit(k).drop("d", "vector", "seq")


def upsert(store: DataFrame, new: DataFrame, cap: int = STORE_CAP) -> DataFrame:
    """The store (key, seq and others) with new rows in place of those with their keys; the `cap` newest by seq stay."""
    rows = store.join(new.select("key"), "key", "left_anti").unionByName(new)
    return rows.orderBy(F.desc("seq"), "key").limit(cap)


def describe(both: DataFrame, labels: DataFrame, pixel_ha: float, settings: Settings = SETTINGS) -> DataFrame:
    """(aoi, vector): the 13 dimensions of an analysed area, from its end epochs (`detect.pair`) and its labelled change.

    Shares of plant, built and water pixels before, after and their change; share changed; density, fragmentation and size of the clusters that are described in detail.
    """
    shares = {"veg": ("NDVI", settings.vegetation), "built": ("NDBI", 0.0), "water": ("MNDWI", settings.water)}
    share = lambda name, end: F.avg((index(shares[name][0], end) > shares[name][1]).cast("int")).alias(name + end)
    base = both.where("valid").groupBy("aoi").agg(F.count("*").alias("n"), *(share(name, end) for name in shares for end in ("_b", "_a")))
    found = labels.groupBy("aoi").agg(F.count("*").alias("changed"), F.least(F.count_distinct("label"), F.lit(settings.detail_cap)).alias("ncl"))
    rows = base.join(found, "aoi", "left").fillna(0, ["changed", "ncl"])
    n, changed, ncl = (F.col(c).cast("double") for c in ("n", "changed", "ncl"))
    capped = lambda x: F.least(x, F.lit(1.0))
    density = ncl / (F.greatest(n * pixel_ha, F.lit(1e-6)) / 100)
    broken = F.when(changed > 0, ncl / F.greatest(changed, F.lit(1.0))).otherwise(0.0)
    patch = F.when(ncl > 0, changed * pixel_ha / F.greatest(ncl, F.lit(1.0))).otherwise(0.0)
    classes = [x for name in shares for x in (F.col(f"{name}_b"), F.col(f"{name}_a"), F.col(f"{name}_a") - F.col(f"{name}_b"))]
    return rows.select("aoi", F.array(*classes, changed / n, capped(density / 10), capped(broken * 50), capped(patch / 50)).alias("vector"))


def explain(a: Column, b: Column) -> Column:
    """The two of NAMED_DIMENSIONS in which the vectors agree best, by weight, with both values; equal gaps by position."""
    at = [SIGNATURE_NAMES.index(n) for n in NAMED_DIMENSIONS]
    gaps = F.array(*(
        F.struct((F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * SIGNATURE_WEIGHTS[i]).alias("gap"), F.lit(i).alias("i"), F.lit(text).alias("text"), F.get(a, F.lit(i)).alias("x"), F.get(b, F.lit(i)).alias("y"))
        for i, text in zip(at, NAMED_DIMENSIONS.values(), strict=True)
    ))
    named = F.transform(F.slice(F.array_sort(gaps), 1, 2), lambda g: F.format_string("%s (%+.2f vs %+.2f)", g["text"], g["x"], g["y"]))
    return F.concat(F.lit("Closest agreement on "), F.concat_ws(" and ", named), F.lit("."))
