"""Connected components of a link table by alternating large and small stars (Kiveris and others, 2014), in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, scratch

#: Rows of a star table from which the least ends are written before the join, so that Spark can split a hub's rows over tasks.
SPLIT = 1 << 20


def _lowest(sym: DataFrame, rows: int) -> DataFrame:
    least = sym.groupBy("u").agg(F.min("v").alias("m"))
    if rows >= SPLIT:
        least = saved(least, "least")
    return sym.join(least.select("u", F.least("u", "m").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b long): component is the smallest node that links reach.

    Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    with scratch() as own:
        edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        state, rows = None, edges.count()
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _lowest(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            if rows >= SPLIT:
                large = saved(large, "large")
            small = _lowest(large, rows)
            small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            edges, before = saved(small.where("u <> v").distinct(), "stars"), edges
            discard(before)
            now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
            if now == state:
                break
            state, rows = now, now[0]
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return own.keep(saved(ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components"))
