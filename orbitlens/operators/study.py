"""Study windows: one window of a set size in each country-sized region, inside its boundary and on the ground that the question is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COUNTRY_SPAN, MOVE_STEPS, MOVES, PROBES, SCAN_X, SCAN_Y
from ..constants import LAND_METRES as LAND
from ..constants import STUDY_SIDE as WINDOW
from ..sources.files import elevations
from .places import inside_rings


def is_country_scale(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.greatest(F.abs(e - w), F.abs(n - s)) >= COUNTRY_SPAN


def inside_boundary(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points (name, pid, lon, lat) with `inside`: by parity of their region's edges (name, x0, y0, x1, y1); null where the region has none."""
    bounded = edges.select("name").distinct().withColumn("bounded", F.lit(True))
    out = inside_rings(points, edges, ("name",)).join(bounded, "name", "left")
    return out.withColumn("inside", F.when(F.col("bounded"), F.col("inside"))).drop("bounded")


def study_windows(regions: DataFrame, edges: DataFrame, dem: DataFrame, prefer: str = "water") -> DataFrame:
    """(name, lon, lat, elevation, coverage, method) of country-sized regions (name, w, s, e, n); smaller ones keep the centre of their box (method direct).

    Of a scan's cells inside the boundary, water takes the lowest land (if none is land, the lowest cell), others the cell of middle height; without heights the middle cell,
    and without cells the centre of the box.  The window is then held inside the box and moved to where most probes are inside, the least move first.
    """
    box = [F.col(c) for c in "wsen"]
    small = regions.where(~is_country_scale(*box)).select("name", ((F.col("w") + F.col("e")) / 2).alias("lon"), ((F.col("s") + F.col("n")) / 2).alias("lat"), F.lit(None).cast("double").alias("elevation"), F.lit(None).cast("double").alias("coverage"), F.lit("direct").alias("method"))
    large = regions.where(is_country_scale(*box)).select("name", *"wsen")
    cells = large.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(SCAN_X * SCAN_Y - 1))))
    cells = cells.withColumns({"lon": F.col("w") + (F.col("e") - F.col("w")) * (F.col("pid") % SCAN_X + 0.5) / SCAN_X, "lat": F.col("s") + (F.col("n") - F.col("s")) * (F.floor(F.col("pid") / SCAN_X) + 0.5) / SCAN_Y})
    cells = elevations(inside_boundary(cells.select("name", "pid", "lon", "lat"), edges).where("inside IS NULL OR inside"), dem)
    spot = F.struct("elevation", "pid", "lon", "lat")
    found = cells.groupBy("name").agg(
        F.min(F.when(F.col("elevation") >= LAND, spot)).alias("land"),
        F.array_sort(F.collect_list(F.when(F.col("elevation").isNotNull(), spot))).alias("known"),
        F.array_sort(F.collect_list(F.struct("pid", "lon", "lat"))).alias("every"),
    )  # at most SCAN_X * SCAN_Y cells a region
    middle = lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int"))
    spread = F.size("known") > 0
    if prefer == "water":
        best = F.coalesce("land", F.get("known", F.lit(0)))
        method = F.when(F.col("land").isNotNull(), "lowest-land-in-country").when(spread, "lowest-elevation-in-country")
    else:
        best, method = middle("known"), F.when(spread, "median-elevation-in-country")
    picked = large.join(found, "name", "left").withColumns({"best": best, "centre": middle("every"), "method": F.coalesce(method, F.when(F.col("every").isNotNull(), "in-country-centre"), F.lit("centroid-fallback"))})
    half = WINDOW / 2
    held = lambda x, a, b: F.when(b - a > WINDOW, F.least(F.greatest(x, a + half), b - half)).otherwise((a + b) / 2)
    at = lambda c, a, b: held(F.coalesce(F.col(f"best.{c}"), F.col(f"centre.{c}"), (F.col(a) + F.col(b)) / 2), F.col(a), F.col(b))
    picked = picked.select("name", *"wsen", "method", F.col("best.elevation").alias("elevation"), at("lon", "w", "e").alias("lon"), at("lat", "s", "n").alias("lat"))
    moves = [(0, 0.0, 0.0)] + [(1 + i * len(MOVES) + j, dx * WINDOW * step, dy * WINDOW * step) for i, step in enumerate(MOVE_STEPS) for j, (dx, dy) in enumerate(MOVES)]
    options = F.array(*(F.struct(F.lit(o).alias("o"), (F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat")) for o, dx, dy in moves))
    tries = picked.select("name", *"wsen", F.explode(options).alias("m")).select("name", *"wsen", "m.*")
    tries = tries.where((F.col("o") == 0) | (F.col("lon").between(F.col("w") + half, F.col("e") - half) & F.col("lat").between(F.col("s") + half, F.col("n") - half)))
    probes = F.array(*(F.struct(F.lit(i * len(PROBES) + j).alias("i"), (F.col("lon") + x * half).alias("x"), (F.col("lat") + y * half).alias("y")) for i, x in enumerate(PROBES) for j, y in enumerate(PROBES)))
    probed = tries.withColumn("p", F.explode(probes)).select("name", "o", F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"), (F.col("o") * 100 + F.col("p.i")).alias("pid"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    share = inside_boundary(probed, edges).where("inside IS NOT NULL").groupBy("name", "o", "at_lon", "at_lat").agg(F.avg(F.col("inside").cast("int")).alias("coverage"))
    chosen = share.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("coverage"), "o"))).where("nth = 1").drop("nth")
    moved = picked.join(chosen, "name", "left").select("name", F.coalesce("at_lon", "lon").alias("lon"), F.coalesce("at_lat", "lat").alias("lat"), F.col("elevation").alias("was"), "coverage", "method", (F.col("o") > 0).alias("shifted"))
    out = elevations(moved, dem).withColumn("elevation", F.when(F.col("shifted"), F.coalesce("elevation", "was")).otherwise(F.col("was")))
    return out.select("name", "lon", "lat", "elevation", "coverage", "method").unionByName(small)
