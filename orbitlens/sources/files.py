"""File-backed sources and sinks: scene features, geocoder, boundaries, elevations, pixel pyramids, the signature store, frames and reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import SETTINGS, Settings
from ..operators.places import clamp_box, look_up
from ..operators.scenes import project, with_days

#: Scenes a year that a search takes, those with the least cloud first; a search asks for at most three pages of a hundred.
YEAR_CAP = 300
#: Half the side of the box around a geocoded point that has none, in degrees.
POINT_BOX = 0.08


# ---- scenes ------------------------------------------------------------------------------------------------------------------------------------


def search_scenes(spark: SparkSession, folder: str, start: int, end: int, settings: Settings = SETTINGS, max_cloud: float | None = None, box: tuple | None = None) -> DataFrame:
    """`found_scenes` of the features under `folder`/year=YYYY (one JSON text a line).  Years are partitions, so others are never listed."""
    lines = spark.read.schema("value string, year int").text(folder)
    return found_scenes(lines.select(F.col("value").alias("feature"), "year"), start, end, settings, max_cloud, box)


def found_scenes(features: DataFrame, start: int, end: int, settings: Settings = SETTINGS, max_cloud: float | None = None, box: tuple | None = None) -> DataFrame:
    """Scenes of (feature, year) of the years asked for, that meet `box` (w, s, e, n; those that state no bounds do) and are below the cloud limit.

    The limit is the settings' if null or 0; if no scene passes, the relaxed one holds.  Of a year's scenes the YEAR_CAP least clouded count.
    """
    found = with_days(project(features.where(F.col("year").between(start, end)).select("feature"))).where(F.col("year").between(start, end))
    if box:
        w, s, e, n = (F.lit(float(x)) for x in box)
        at = lambda i: F.get("bbox", F.lit(i))
        found = found.where(F.col("bbox").isNull() | ((at(0) <= e) & (at(2) >= w) & (at(1) <= n) & (at(3) >= s)))
    found = found.drop("bbox")
    strict = _least_cloud(found.where(F.col("cloud") < (max_cloud or settings.max_cloud)))
    return strict if strict.take(1) else _least_cloud(found.where(F.col("cloud") < settings.relaxed_cloud))


def _least_cloud(scenes: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("year").orderBy("cloud", "id"))
    return scenes.withColumn("nth", nth).where(F.col("nth") <= YEAR_CAP).drop("nth")


# ---- places ------------------------------------------------------------------------------------------------------------------------------------

GEOCODER = "query string, lat string, lon string, boundingbox array<string>, display_name string"
BOUNDARY = "name string, geojson string, w double, s double, e double, n double"


def geocode(names: DataFrame, answers: DataFrame) -> DataFrame:
    """(query, label, lon, lat, box, source) of place names: the gazetteer's entry, else the geocoder's first answer (GEOCODER), else nulls.

    A geocoder's box lists south, north, west, east; an answer without one gets a box around its point.
    """
    from ..operators.places import gazetteer

    entry = gazetteer(names.sparkSession).select("key", "lon", "lat", *"wsen")
    known = look_up(names).join(F.broadcast(entry), "key", "left").select("query", "label", "lon", "lat", clamp_box(*(F.col(c) for c in "wsen")).alias("box"))
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    at = answers.select(F.lower(F.trim("query")).alias("name"), "display_name", number("lon").alias("x"), number("lat").alias("y"), *(number(f"get(boundingbox, {i})").alias(c) for i, c in enumerate("snwe")))
    at = at.where("x IS NOT NULL AND y IS NOT NULL").groupBy("name").agg(F.min(F.struct("display_name", "x", "y", *"wsen")).alias("a"))
    side = lambda c, point, sign: F.coalesce(F.col(f"a.{c}"), F.col(f"a.{point}") + sign * POINT_BOX)
    at = at.select("name", "a", clamp_box(side("w", "x", -1), side("s", "y", -1), side("e", "x", 1), side("n", "y", 1)).alias("far"))
    rows = known.withColumn("name", F.lower(F.trim("query"))).join(at, "name", "left")
    source = F.when(F.col("label").isNotNull(), "gazetteer").when(F.col("a").isNotNull(), "geocoder")
    return rows.select("query", F.coalesce("label", "a.display_name").alias("label"), F.coalesce("lon", "a.x").alias("lon"), F.coalesce("lat", "a.y").alias("lat"), F.coalesce("box", "far").alias("box"), source.alias("source"))


def boundary_edges(boundaries: DataFrame) -> DataFrame:
    """(name, x0, y0, x1, y1): edges of the exterior rings of (name, geojson) polygons, multi-polygons and collections of them.

    Rings of fewer than four points, and texts that are no such shape, give none.
    """
    shape = lambda c: F.from_json(c, "type string, coordinates string, geometries array<string>")
    whole = boundaries.select("name", F.explode(F.concat(F.array("geojson"), F.coalesce(shape(F.col("geojson"))["geometries"], F.array().cast("array<string>")))).alias("g"))
    parts = whole.select("name", shape(F.col("g")).alias("g"))
    ring = T.ArrayType(T.ArrayType(T.DoubleType()))
    polygon = F.from_json("g.coordinates", T.ArrayType(ring))
    several = F.from_json("g.coordinates", T.ArrayType(T.ArrayType(ring)))
    outer = F.when(F.col("g.type") == "Polygon", F.array(F.get(polygon, F.lit(0)))).when(F.col("g.type") == "MultiPolygon", F.transform(several, lambda p: F.get(p, F.lit(0))))
    rings = parts.select("name", F.explode(outer).alias("ring")).where("size(ring) >= 4")
    ends = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % F.size("ring")).alias("b")))
    edges = rings.select("name", F.explode(ends).alias("e"))
    return edges.select("name", *(F.col(f"e.{p}")[i].alias(f"{c}{j}") for j, p in enumerate("ab") for i, c in enumerate("xy")))


def elevations(points: DataFrame, dem: DataFrame) -> DataFrame:
    """`points` (lon, lat and others) with `elevation` from `dem` (lon, lat, elevation), matched on four decimals; null where it has none."""
    height = dem.groupBy(F.round("lon", 4).alias("_x"), F.round("lat", 4).alias("_y")).agg(F.max("elevation").alias("elevation"))
    return points.withColumns({"_x": F.round("lon", 4), "_y": F.round("lat", 4)}).join(height, ["_x", "_y"], "left").drop("_x", "_y")


# ---- pixel pyramids ----------------------------------------------------------------------------------------------------------------------------


def write_pyramid(pixels: DataFrame, path: str, levels=(1, 2, 4, 8, 16), bands=("red", "green", "blue", "nir", "swir16")) -> None:
    """Raw pixels (aoi, scene_id, r, c, bands, scl) at full size and as means of level x level blocks, one partition folder a level.

    Zeros are no data: they take no part in a mean, and a block without data is 0.  The class of a block is that of its first pixel.
    """
    whole = pixels.select("aoi", "scene_id", "r", "c", *(F.col(b).cast("double").alias(b) for b in bands), "scl", F.lit(1).alias("level"))
    out = whole
    for level in levels:
        if level > 1:
            block = whole.withColumns({"br": F.floor(F.col("r") / level).cast("int"), "bc": F.floor(F.col("c") / level).cast("int")})
            means = [F.coalesce(F.avg(F.when(F.col(b) != 0, F.col(b))), F.lit(0.0)).alias(b) for b in bands]
            block = block.groupBy("aoi", "scene_id", "br", "bc").agg(*means, F.min_by("scl", F.struct("r", "c")).alias("scl"))
            out = out.unionByName(block.withColumnsRenamed({"br": "r", "bc": "c"}).withColumn("level", F.lit(level)))
    out.write.mode("overwrite").partitionBy("level").parquet(path)


def read_pyramid(spark: SparkSession, path: str, level: int) -> DataFrame:
    """The pixels of one level; other levels' files are not opened."""
    return spark.read.parquet(path).where(F.col("level") == level).drop("level")


# ---- signature store ---------------------------------------------------------------------------------------------------------------------------

STORE = "key string, seq long, label string, lon double, lat double, period string, mode string, vector array<double>, headline string, area_ha double"
#: Versions of the store that stay beside a new one, for readers under way.
OLD_VERSIONS = 1


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of the signature store; an empty table if there is none."""
    versions = _versions(spark, path)
    return spark.read.schema(STORE).parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], STORE)


def write_store(store: DataFrame, path: str) -> None:
    """Writes the next version beside the present one, so a reader, or a write that fails half-way, never meets half a store; older versions go."""
    spark = store.sparkSession
    versions = _versions(spark, path)
    store.select(*(f.name for f in T._parse_datatype_string(STORE).fields)).write.mode("overwrite").parquet(f"{path}/v{(versions[-1] if versions else 0) + 1}")
    for old in versions[: len(versions) - OLD_VERSIONS]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# ---- frames ------------------------------------------------------------------------------------------------------------------------------------


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers, also those inside arrays, as null."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def frames(df: DataFrame) -> DataFrame:
    """One JSON line (column `value`) a row; nulls are written, numbers that JSON can't hold are null."""
    return finite(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_frames(df: DataFrame, path: str) -> None:
    frames(df).write.mode("overwrite").text(path)


def parse_frames(text: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (column `value`); lines that are not JSON are skipped."""
    rows = text.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("x"))
    return rows.where("x IS NOT NULL AND x._bad IS NULL").select("x.*").drop("_bad")


def read_frames(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_frames(spark.read.text(path), schema)


def lines(df: DataFrame) -> Iterator[str]:
    """The rows as JSON lines, one partition at a time on the driver."""
    return (row["value"] + "\n" for row in frames(df).toLocalIterator())
