"""What an analysis reads, as tables or as a folder of files, and how one epoch is loaded from it onto a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.indices import BANDS, degraded_class, pedestals, reflectance, usable_pixel
from ..operators.detect import mosaic
from ..operators.raster import outline, overview_level, warp
from ..scratch import saved
from . import files

FEATURES = "feature string, year int"
DEM = "lon double, lat double, elevation double"
#: Where a scene's images lie: reference system, upper left corner, size of a pixel in its units, and pixels, by level of the pyramid.
FOOTPRINTS = "scene_id string, level int, epsg int, x0 double, y0 double, dx double, dy double, rows int, cols int"
#: Raw numbers, 0 for no data.
IMAGES = "scene_id string, level int, r int, c int, red int, green int, blue int, nir int, swir16 int, scl int"


class Unreachable(Exception):
    """The catalog cannot be read at all."""


@dataclass
class Archive:
    """The tables of an archive; `features` and `images` may be of any size and are read by year, scene and level."""

    features: DataFrame
    footprints: DataFrame
    images: DataFrame
    answers: DataFrame
    boundaries: DataFrame
    dem: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Archive:
        """The archive in a folder: scenes/year=YYYY (JSON lines), footprints, images/level=N and dem (Parquet), places and boundaries (JSON lines).

        Missing places, boundaries or heights count as empty; a catalog that cannot be read raises Unreachable.
        """

        def read(kind: str, name: str, schema: str) -> DataFrame:
            try:
                return getattr(spark.read.schema(schema), kind)(f"{folder}/{name}")
            except AnalysisException:
                return spark.createDataFrame([], schema)

        try:
            lines = spark.read.schema("value string, year int").text(f"{folder}/scenes")
            footprints, images = (spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in (("footprints", FOOTPRINTS), ("images", IMAGES)))
        except AnalysisException as e:
            raise Unreachable(str(e)) from e
        return cls(lines.select(F.col("value").alias("feature"), "year"), footprints, images, read("json", "places", files.GEOCODER), read("json", "boundaries", files.BOUNDARY), read("parquet", "dem", DEM))

    def write(self, folder: str) -> None:
        """Writes the tables as `open` reads them."""
        self.features.select(F.col("feature").alias("value"), "year").write.mode("overwrite").partitionBy("year").text(f"{folder}/scenes")
        self.images.write.mode("overwrite").partitionBy("level").parquet(f"{folder}/images")
        self.footprints.write.mode("overwrite").parquet(f"{folder}/footprints")
        self.answers.write.mode("overwrite").json(f"{folder}/places")
        self.boundaries.write.mode("overwrite").json(f"{folder}/boundaries")
        self.dem.write.mode("overwrite").parquet(f"{folder}/dem")


def read_plan(archive: Archive, wanted: DataFrame, box: tuple, height: int, width: int) -> DataFrame:
    """(keys of `wanted`, scene_id, level, epsg, x0, y0, dx, dy): the level of the pyramid to read of each wanted scene, by the size of the box in its pixels."""
    prints = archive.footprints.join(F.broadcast(wanted.select("scene_id").distinct()), "scene_id", "left_semi")
    whole = prints.groupBy("scene_id").agg(F.min_by(F.struct("epsg", "dx", "dy"), "level").alias("p"), F.array_sort(F.collect_set("level")).alias("levels"))
    at = whole.withColumn("o", outline(box, F.col("p.epsg")))
    level = overview_level(F.abs(F.col("o.right") - F.col("o.left")) / F.col("p.dx"), F.abs(F.col("o.top") - F.col("o.bottom")) / F.col("p.dy"), F.lit(width), F.lit(height), F.col("levels"))
    return wanted.join(at.select("scene_id", level.alias("level")), "scene_id").join(prints.drop("rows", "cols"), ["scene_id", "level"])


def load_epochs(archive: Archive, wanted: DataFrame, box: tuple, height: int, width: int) -> DataFrame:
    """(k, r, c, bands, scl, valid, degraded, pedestal, filled): every cell of the grid over `box` for every epoch of `wanted` (k, ord, scene_id; at most a few dozen rows).

    An epoch is its scene (ord 0) with the cells it does not cover taken from its companions, in order.  Bands are reflectances; an offset that even the darkest SWIR
    numbers of an epoch carry is taken off.  What cannot be read counts as no data, which is not valid; `filled` tells the cells that a companion gave.
    """
    spark = archive.images.sparkSession
    plan = read_plan(archive, wanted.select("k", "ord", "scene_id"), box, height, width).collect()
    schema = "scene_id string, level int, k int, ord int, epsg int, x0 double, y0 double, dx double, dy double"
    sources = spark.createDataFrame([(p.scene_id, p.level, p.k, p.ord, p.epsg, p.x0, p.y0, p.dx, p.dy) for p in plan], schema)
    images = archive.images.where(F.col("level").isin(sorted({p.level for p in plan})) & F.col("scene_id").isin(sorted({p.scene_id for p in plan})))
    found = warp(images, sources, ["k", "ord"], box, height, width)
    found = found.withColumn("from", F.col("ord"))
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    every = wanted.select("k").distinct().join(cells)
    raw = saved(every.join(mosaic(found, (*BANDS, "scl", "from"), ("k", "r", "c")), ["k", "r", "c"], "left").fillna(0, [*BANDS, "scl", "from"]), "raw")
    rows = raw.withColumns({"valid": usable_pixel(), "degraded": degraded_class()}).join(pedestals(raw, ["k"]).select("k", "pedestal"), "k")
    return rows.select("k", "r", "c", *(reflectance(F.col(b), F.col("pedestal")).alias(b) for b in BANDS), "scl", "valid", "degraded", "pedestal", (F.col("from") > 0).alias("filled"))


def epoch_quality(rows: DataFrame) -> DataFrame:
    """(k, valid_fraction, degraded_fraction, filled_fraction, pedestal) of the cells of `load_epochs`."""
    share = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_fraction")
    return rows.groupBy("k").agg(share("valid"), share("degraded"), share("filled"), F.max("pedestal").alias("pedestal"))
