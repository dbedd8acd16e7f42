"""Places: gazetteer, bounding boxes, grids, point in polygon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import GAZETTEER, KM_LAT, KM_LON, SETTINGS, Settings


#: Degrees of a band of latitude.
BAND = 1.0


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *g) for i, g in enumerate(GAZETTEER)], "ord int, key string, label string, lon double, lat double, w double, s double, e double, n double")


def look_up(places: DataFrame) -> DataFrame:
    """(query, key, label): exact name, else the part before the first comma, else the first entry that holds the name or is held by it; null if none."""
    g = gazetteer(places.sparkSession).select("ord", F.col("key").alias("g"), "label")
    name = F.lower(F.trim("query"))
    rows = places.select("query").distinct().withColumn("name", name).withColumn("head", F.trim(F.substring_index("name", ",", 1)))
    tier = F.when(F.col("g") == F.col("name"), 0).when(F.col("name").contains(",") & (F.col("g") == F.col("head")), 1).when(F.col("name").contains(F.col("g")) | F.col("g").contains(F.col("name")), 2)
    hits = rows.where("name <> ''").crossJoin(F.broadcast(g)).withColumn("tier", tier).where("tier IS NOT NULL")
    best = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("tier", "ord"))).where("nth = 1")
    return rows.select("query").join(best.select("query", F.col("g").alias("key"), "label"), "query", "left")


def clamp_box(w: Column, s: Column, e: Column, n: Column, settings: Settings = SETTINGS) -> Column:
    """The box (struct w, s, e, n) in order, inside the world, and neither too small nor too large about its centre; null where a side is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    whole = finite(w) & finite(s) & finite(e) & finite(n)
    swapped = ((F.abs(w) > 180) | (F.abs(e) > 180)) & (F.abs(s) <= 180) & (F.abs(n) <= 180)
    w, s, e, n = (F.when(swapped, x).otherwise(y) for x, y in ((s, w), (w, s), (n, e), (e, n)))
    hold = lambda x, m: F.greatest(F.lit(-m), F.least(F.lit(m), x))
    w, e = hold(F.least(w, e), 180.0), hold(F.greatest(w, e), 180.0)
    s, n = hold(F.least(s, n), 85.0), hold(F.greatest(s, n), 85.0)
    size = lambda a, b: F.greatest(F.lit(settings.min_aoi), F.least(F.lit(settings.max_aoi), b - a))
    cx, cy, dx, dy = (w + e) / 2, (s + n) / 2, size(w, e), size(s, n)
    box = F.struct(F.round(cx - dx / 2, 6).alias("w"), F.round(cy - dy / 2, 6).alias("s"), F.round(cx + dx / 2, 6).alias("e"), F.round(cy + dy / 2, 6).alias("n"))
    return F.when(whole, box)


def pixel_ha(w: Column, s: Column, e: Column, n: Column, width: Column, height: Column) -> Column:
    """Ground area of a pixel in hectares, by the length of a degree at the middle latitude."""
    mid = F.radians((s + n) / 2)
    per_lat = 111132.92 - 559.82 * F.cos(2 * mid) + 1.175 * F.cos(4 * mid)
    per_lon = 111412.84 * F.cos(mid) - 93.5 * F.cos(3 * mid)
    return F.abs(n - s) / height * per_lat * (F.abs(e - w) / width * F.abs(per_lon)) / 10000


def grid_size(w: Column, s: Column, e: Column, n: Column, target: int | Column = SETTINGS.grid_size) -> Column:
    """Struct (width, height): the long side has `target` pixels, the short one 64 at least; null for a box without width or height."""
    dx, dy = F.abs(e - w), F.abs(n - s)
    target = F.lit(target) if isinstance(target, int) else target
    short = lambda a, b: F.greatest(F.lit(64), F.bround(target * a / b).cast("int"))
    size = F.struct(F.when(dx >= dy, target).otherwise(short(dx, dy)).alias("width"), F.when(dx >= dy, short(dy, dx)).otherwise(target).alias("height"))
    return F.when((dx > 0) & (dy > 0), size)


def grid_target(w: Column, s: Column, e: Column, n: Column, wanted: Column, settings: Settings = SETTINGS) -> Column:
    """Pixels along the long side of a box's grid: those wanted (the settings' if null or 0), fewer for a very large box."""
    asked = F.when(F.coalesce(wanted, F.lit(0)) > 0, wanted).otherwise(settings.grid_size)
    return F.when(F.greatest(e - w, n - s) >= settings.large_span, F.least(asked, F.lit(settings.large_grid))).otherwise(asked).cast("int")


def box_km(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Struct (wide, high, area): a box's size for reading, in kilometres, with equal degrees everywhere."""
    wide, high = (e - w) * KM_LON, (n - s) * KM_LAT
    return F.struct(wide.alias("wide"), high.alias("high"), F.bround(wide * high, 1).alias("area"))


def point_box(lon: Column, lat: Column, side: float = 0.12, settings: Settings = SETTINGS) -> Column:
    """The clamped box of that many degrees a side around a point."""
    return clamp_box(lon - side / 2, lat - side / 2, lon + side / 2, lat + side / 2, settings)


def inside_rings(points: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points (keys, pid, lon, lat) with `inside`: an odd number of their keys' ring edges (keys, x0, y0, x1, y1) lie to the right.

    Edges are dealt to the bands of latitude that they cross, and a point meets those of its own band alone, so the join is one on equal keys.
    """
    band = lambda y: F.floor(F.col(y) / BAND).cast("int")
    dealt = edges.where(F.col("y0") != F.col("y1")).withColumn("band", F.explode(F.sequence(F.least(band("y0"), band("y1")), F.greatest(band("y0"), band("y1")))))
    at = F.col("x0") + (F.col("lat") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    cross = ((F.col("y0") > F.col("lat")) != (F.col("y1") > F.col("lat"))) & (F.col("lon") < at)
    own = [*keys, "pid"]
    hits = points.withColumn("band", band("lat")).join(dealt.select(*keys, "band", "x0", "y0", "x1", "y1"), [*keys, "band"]).where(cross).groupBy(*own).agg(F.count("*").alias("hits"))
    return points.join(hits, own, "left").withColumn("inside", F.coalesce(F.col("hits"), F.lit(0)) % 2 == 1).drop("hits")
