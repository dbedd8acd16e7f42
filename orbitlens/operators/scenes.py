"""Selection of comparable scenes from a catalog table (id, date, cloud, mgrs, assets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SETTINGS, Settings
from ..functions.indices import circular_days

REQUIRED = ("red", "green", "blue", "nir", "swir16", "scl")


def project(features: DataFrame) -> DataFrame:
    """Scenes of raw catalog features (one JSON text a row, column `feature`); those without all bands or a readable date are dropped."""
    v = F.try_parse_json("feature")
    text = lambda path: F.try_variant_get(v, path, "string")
    taken = F.try_to_timestamp(F.regexp_replace(F.coalesce(text("$.properties.datetime"), text("$.properties.start_datetime")), "Z$", "+00:00"))
    assets = F.create_map(*(x for b in REQUIRED for x in (F.lit(b), text(f"$.assets.{b}.href"))))
    out = features.select(
        text("$.id").alias("id"),
        F.to_date(taken).alias("date"),
        F.coalesce(F.try_variant_get(v, "$.properties['eo:cloud_cover']", "double"), F.lit(100.0)).alias("cloud"),
        F.coalesce(text("$.properties['grid:code']"), text("$.properties['s2:mgrs_tile']")).alias("mgrs"),
        assets.alias("assets"),
        F.try_variant_get(v, "$.bbox", "array<double>").alias("bbox"),
    )
    return out.where(F.col("date").isNotNull() & F.forall(F.map_values("assets"), lambda x: x.isNotNull() & (x != "")))


def with_days(scenes: DataFrame) -> DataFrame:
    return scenes.withColumns({"year": F.year("date"), "doy": F.dayofyear("date")})


def season_anchor(scenes: DataFrame, window: int = SETTINGS.season_days) -> DataFrame:
    """(anchor, covered, med): the day of the year, of 15, 25 ... 365, around which most years have a scene; then the least upper median of yearly least clouds, then the earliest."""
    anchors = scenes.sparkSession.range(36).select((F.col("id") * 10 + 15).cast("int").alias("anchor"))
    near = scenes.crossJoin(F.broadcast(anchors)).where(circular_days(F.col("doy"), F.col("anchor")) <= window)
    yearly = near.groupBy("anchor", "year").agg(F.min("cloud").alias("cloud"))
    upper = F.element_at(F.array_sort(F.collect_list("cloud")), (F.count("*") / 2).cast("int") + 1)
    score = yearly.groupBy("anchor").agg(F.count("*").alias("covered"), upper.alias("med"))
    return score.orderBy(F.desc("covered"), "med", "anchor").limit(1)


def tile_coverage(scenes: DataFrame) -> DataFrame:
    return scenes.where("mgrs IS NOT NULL").groupBy("mgrs").agg(F.count("*").alias("n"), F.count_distinct("year").alias("years"))


def preferred_tile(scenes: DataFrame) -> DataFrame:
    """(mgrs): the tile with most years if it misses none, else no row."""
    years = scenes.agg(F.count_distinct("year").alias("all_years"))
    return tile_coverage(scenes).orderBy(F.desc("years"), F.desc("n"), "mgrs").limit(1).crossJoin(F.broadcast(years)).where("years >= all_years").select("mgrs")


def missed_years(scenes: DataFrame) -> DataFrame:
    """(mgrs, missed): for each tile the years, in order, that some scene covers but none of its own."""
    every = scenes.agg(F.collect_set("year").alias("years"))
    own = scenes.where("mgrs IS NOT NULL").groupBy("mgrs").agg(F.collect_set("year").alias("own"))
    return own.crossJoin(F.broadcast(every)).select("mgrs", F.array_sort(F.array_except("years", "own")).alias("missed"))


def best_per_year(scenes: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One scene a year: inside the season (else twice as wide), of the preferred tile if it has any, least cloud (to a tenth), then nearest day, then id."""
    w = settings.season_days
    anchor = season_anchor(scenes, w).select("anchor")
    tile = preferred_tile(scenes).select(F.col("mgrs").alias("tile"))
    rows = scenes.crossJoin(F.broadcast(anchor)).withColumn("days", circular_days(F.col("doy"), F.col("anchor"))).where(F.col("days") <= 2 * w)
    rows = rows.withColumn("tier", (F.col("days") > w).cast("int")).join(F.broadcast(tile), F.col("mgrs") == F.col("tile"), "left").withColumn("own", F.col("tile").isNotNull().cast("int"))
    year = Window.partitionBy("year")
    rows = rows.withColumn("best_tier", F.min("tier").over(year)).where("tier = best_tier")
    order = Window.partitionBy("year").orderBy(F.desc("own"), F.bround("cloud", 1), "days", "id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*scenes.columns, "anchor", F.col("tier").cast("boolean").alias("relaxed"))


def rejected(chosen: DataFrame, start: int, end: int) -> DataFrame:
    """(year, reason) of the years from `start` to `end` that `best_per_year` gave no scene (missing) or one outside the season (relaxed)."""
    years = chosen.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("year"))
    rows = years.join(chosen.select("year", "relaxed"), "year", "left")
    return rows.where("relaxed IS NULL OR relaxed").select("year", F.when(F.col("relaxed"), "relaxed").otherwise("missing").alias("reason"))


def anchor_label(anchor: Column) -> Column:
    """The day of the year as day and month of a leap year."""
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), anchor - 1), "dd MMMM")


def tiles(chosen: DataFrame) -> DataFrame:
    """(tiles): one row, the distinct tiles of the chosen scenes in order."""
    return chosen.agg(F.array_sort(F.collect_set("mgrs")).alias("tiles"))


def selection_notes(scenes: DataFrame, chosen: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(notes): one row, sentences on how `best_per_year` chose: the season, years that a single tile would miss, and the tiles in use."""
    best = tile_coverage(scenes).orderBy(F.desc("years"), F.desc("n"), "mgrs").limit(1).join(missed_years(scenes), "mgrs").select(F.col("mgrs").alias("best"), "missed")
    rows = chosen.agg(F.min("anchor").alias("anchor"), F.count("*").alias("n")).crossJoin(tiles(chosen)).join(F.broadcast(best), F.lit(True), "left")
    season = F.when(F.col("n") > 0, F.concat(F.lit("All dates lie near "), anchor_label(F.col("anchor")), F.lit(f" (at most {settings.season_days} days off where possible), so plants and sun are alike.")))
    apart = F.when(F.size("missed") > 0, F.format_string("No tile covers all years (the best one misses %s), so each year has its clearest tile.", F.concat_ws(", ", F.transform("missed", lambda y: y.cast("string")))))
    whole = F.size("missed") == 0
    same = F.when(whole & (F.size("tiles") == 1), F.format_string("All dates come from tile %s.", F.get("tiles", F.lit(0))))
    mixed = F.when(whole & (F.size("tiles") > 1), F.format_string("The dates come from the tiles %s.", F.concat_ws(", ", "tiles")))
    return rows.select(F.array_compact(F.array(season, apart, same, mixed)).alias("notes"))


def companions(scenes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(chosen_id, companion_id, mgrs, ord): for each chosen scene the least cloudy scene of every other tile on its day, numbered from 1 by cloud."""
    pick = chosen.select(F.col("id").alias("chosen_id"), "date", F.col("mgrs").alias("own"))
    rows = scenes.where("mgrs IS NOT NULL").join(pick, "date").where((F.col("own").isNull() | (F.col("mgrs") != F.col("own"))) & (F.col("id") != F.col("chosen_id")))
    order = Window.partitionBy("chosen_id", "mgrs").orderBy("cloud", "id")
    rows = rows.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("chosen_id").orderBy("cloud", "id"))).select("chosen_id", F.col("id").alias("companion_id"), "mgrs", "ord")
