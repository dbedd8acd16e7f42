"""A planted pseudo-raster over `lineitem`: a city that grows, a lake that dries, a clearing, a flood and a burn on vegetated ground, with noise from the table's averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import Frame

#: (class, r0, r1, c0, c1, first year, nir, red, swir16, green); rectangles are shares of the side, the first that fits decides.
CLASSES = (
    ("city", 0.10, 0.30, 0.10, 0.35, 1998, 0.24, 0.20, 0.30, 0.18),
    ("dry", 0.75, 0.85, 0.10, 0.40, 1999, 0.26, 0.22, 0.32, 0.16),
    ("lake", 0.60, 0.85, 0.10, 0.40, 0, 0.05, 0.04, 0.02, 0.09),
    ("clear", 0.10, 0.25, 0.60, 0.80, 1997, 0.20, 0.14, 0.15, 0.12),
    ("lake", 0.55, 0.70, 0.55, 0.90, 2000, 0.05, 0.04, 0.02, 0.09),
    ("burn", 0.75, 0.92, 0.60, 0.85, 1999, 0.12, 0.10, 0.28, 0.07),
    ("veg", 0.0, 2.0, 0.0, 2.0, 0, 0.40, 0.06, 0.18, 0.08),
)
NOISE = {"nir": (0.06, "n1"), "red": (0.2, "n2"), "swir16": (0.1, "n3"), "green": (0.01, "n4")}
YEAR0, YEAR_SHIFT = 1995, 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str) -> int:
    return max(14, round((table(spark, sf_dir, "lineitem").count() / 37.8) ** 0.5))


def frame(spark: SparkSession, sf_dir: str) -> Frame:
    h = side(spark, sf_dir)
    return Frame(h, h)


def _avg_in_order(c: str) -> Column:
    """The mean of a column, added up in the order of the table's files and rows."""
    values = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("file", "at", c))))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, x: total + x[c]), F.size(values))


def pixels(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """The raster's pixels.  Averages are added up as partitions come, so their last bits vary; `in_order` takes the rows as they stand, for bands that are then rounded to whole numbers."""
    h, avg = side(spark, sf_dir), _avg_in_order if in_order else F.avg
    rows = table(spark, sf_dir, "lineitem")
    if in_order:
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    rows = rows.groupBy(F.year("l_shipdate").alias("y"), (F.col("l_orderkey") % h).cast("int").alias("r"), (F.col("l_partkey") % h).cast("int").alias("c"))
    rows = rows.agg((avg("l_quantity") / 50 - 0.5).alias("n1"), (avg("l_discount") - 0.05).alias("n2"), (avg("l_tax") - 0.04).alias("n3"), (avg("l_extendedprice") / 105000 - 0.36).alias("n4"))
    kind = F
    for i, (_, r0, r1, c0, c1, y0, *_) in enumerate(CLASSES):
        kind = kind.when((F.col("r") >= r0 * h) & (F.col("r") < r1 * h) & (F.col("c") >= c0 * h) & (F.col("c") < c1 * h) & (F.col("y") >= y0), F.lit(i))
    rows = rows.withColumn("kind", kind)
    base = {b: F.array(*(F.lit(x[6 + i]) for x in CLASSES)) for i, b in enumerate(NOISE)}
    valid = (F.col("r") * 31 + F.col("c") * 17 + F.col("y") * 7) % 97 != 0
    scl = F.when(~valid, 9).when(F.col("kind").isin(2, 4), 6).when(F.col("kind") == 6, 4).otherwise(5)
    bands = [(F.element_at(base[b], F.col("kind") + 1) + factor * F.col(n)).alias(b) for b, (factor, n) in NOISE.items()]
    return rows.select(F.lit(1).cast("long").alias("aoi"), (F.col("y") - YEAR0).alias("k"), (F.col("y") + YEAR_SHIFT).alias("year"), "r", "c", *bands, scl.alias("scl"), valid.alias("valid"))


def _when(i: int, c: tuple) -> str:
    _, r0, r1, c0, c1, y0, *_ = c
    return f"WHEN r >= {r0}::DOUBLE * h AND r < {r1}::DOUBLE * h AND c >= {c0}::DOUBLE * h AND c < {c1}::DOUBLE * h AND y >= {y0} THEN {i}"


_BANDS_SQL = ", ".join(f"[{', '.join(f'{x[6 + i]}::DOUBLE' for x in CLASSES)}][kind + 1] + {f}::DOUBLE * {n} AS {b}" for i, (b, (f, n)) in enumerate(NOISE.items()))
#: The same table for the oracles: common table expressions hh (h) and px.
SQL = f"""hh AS (SELECT greatest(14, round(sqrt(count(*) / 37.8::DOUBLE)))::INT AS h FROM lineitem),
g AS (SELECT year(l_shipdate)::INT AS y, (l_orderkey % h)::INT AS r, (l_partkey % h)::INT AS c, h, avg(l_quantity) / 50 - 0.5::DOUBLE AS n1, avg(l_discount) - 0.05::DOUBLE AS n2,
  avg(l_tax) - 0.04::DOUBLE AS n3, avg(l_extendedprice) / 105000 - 0.36::DOUBLE AS n4 FROM lineitem, hh GROUP BY ALL),
kd AS (SELECT *, CASE {" ".join(_when(i, c) for i, c in enumerate(CLASSES))} END AS kind, (r * 31 + c * 17 + y * 7) % 97 <> 0 AS valid FROM g),
px AS (SELECT y - {YEAR0} AS k, y + {YEAR_SHIFT} AS year, r, c, {_BANDS_SQL}, CASE WHEN NOT valid THEN 9 WHEN kind IN (2, 4) THEN 6 WHEN kind = 6 THEN 4 ELSE 5 END AS scl, valid FROM kd)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as a scene catalog."""
    from ..operators.scenes import with_days

    o = table(spark, sf_dir, "orders")
    out = o.select(F.col("o_orderkey").cast("string").alias("id"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") % 20).alias("cloud"), F.concat(F.lit("T"), (F.col("o_custkey") % 5).cast("string")).alias("mgrs"))
    return with_days(out)


SCENES_SQL = """s AS (SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS date, o_totalprice % 20 AS cloud, 'T' || (o_custkey % 5) AS mgrs, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy FROM orders)"""


#: Where the pseudo-raster lies for a whole analysis, and the place that names it.
BOX, PLACE = (10.0, 49.9, 10.1, 50.0), "Ringland"


def archive(spark: SparkSession, sf_dir: str):
    """The pseudo-raster as an archive: a scene a year, raw numbers as its images, a place, no boundaries and no heights."""
    from ..sources import archive as archives
    from ..sources import files

    px, h = pixels(spark, sf_dir), side(spark, sf_dir)
    found = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).distinct().collect()
    years = spark.createDataFrame([(r["y"] - YEAR0, r["y"] + YEAR_SHIFT) for r in found], "k int, year int")
    assets = ",".join(f'"{b}":{{"href":"x"}}' for b in ("red", "green", "blue", "nir", "swir16", "scl"))
    feature = F.format_string(f'{{"id":"S%d","bbox":{list(BOX)},"properties":{{"datetime":"%d-05-01T10:00:00Z","eo:cloud_cover":%d,"grid:code":"T1"}},"assets":{{{assets}}}}}', "year", "year", F.col("k") % 5 * 4)
    number = lambda b: F.when(F.col("scl") == 0, 0).otherwise(F.greatest(F.lit(1), F.round(F.col(b) * 10000))).cast("int")
    images = px.select(F.format_string("S%d", "year").alias("scene_id"), F.lit(1).alias("level"), "r", "c", number("red").alias("red"), number("green").alias("green"), number("green").alias("blue"), number("nir").alias("nir"), number("swir16").alias("swir16"), "scl")
    size = (BOX[2] - BOX[0]) / h
    prints = years.select(F.format_string("S%d", "year").alias("scene_id"), F.lit(1).alias("level"), F.lit(4326).alias("epsg"), F.lit(BOX[0]).alias("x0"), F.lit(BOX[3]).alias("y0"), F.lit(size).alias("dx"), F.lit((BOX[3] - BOX[1]) / h).alias("dy"), F.lit(h).alias("rows"), F.lit(h).alias("cols"))
    answers = spark.createDataFrame([(PLACE.lower(), "49.95", "10.05", [str(BOX[1]), str(BOX[3]), str(BOX[0]), str(BOX[2])], f"{PLACE}, Testland")], files.GEOCODER)
    return archives.Archive(years.select(feature.alias("feature"), "year"), prints, images, answers, spark.createDataFrame([], files.BOUNDARY), spark.createDataFrame([], archives.DEM))
