"""Queries on finding scenes and places."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SETTINGS
from ..operators import places, scenes, study
from ..scratch import scratch_path
from ..sources import files
from . import pseudo
from .registry import query, rounded

# ---- the catalog as files -----------------------------------------------------------------------------------------------------------------------


def features(spark, sf_dir) -> DataFrame:
    """`orders` as raw features: one JSON text and its year a row; some lack a band, a date or a cloud share, some are cut short."""
    o, key = pseudo.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    href = lambda b: F.format_string('"%s":{"href":"%s"}', F.lit(b), F.when((F.lit(b) == "nir") & (key % 7 == 0), "").otherwise("x"))
    cloud = F.when(key % 13 == 0, "").otherwise(F.concat(F.lit('"eo:cloud_cover":'), F.round(F.col("o_totalprice") % 60, 2).cast("string"), F.lit(",")))
    date = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    taken = F.when(key % 11 == 0, F.lit('"datetime":"soon"')).when(key % 5 == 0, F.concat(F.lit('"start_datetime":"'), date, F.lit('"'))).otherwise(F.concat(F.lit('"datetime":"'), date, F.lit('"')))
    at = key % 50
    bounds = F.when(key % 3 == 0, "").otherwise(F.format_string('"bbox":[%d,0,%d,1],', at, at + 2))
    text = F.concat(F.lit("{"), bounds, F.lit('"id":"'), key.cast("string"), F.lit('","properties":{'), cloud, F.lit('"grid:code":"T'), (F.col("o_custkey") % 5).cast("string"), F.lit('",'), taken, F.lit('},"assets":{'), F.concat_ws(",", *(href(b) for b in scenes.REQUIRED)), F.lit("}}"))
    return o.select(F.when(key % 17 == 0, F.substring(text, 1, 40)).otherwise(text).alias("feature"), F.year("o_orderdate").alias("year"))


_READABLE = "o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0"


def _search_sql(start: int, end: int, limit: float, meets: str = "TRUE") -> str:
    return f"""WITH s AS (SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 13 = 0 THEN 100::DOUBLE ELSE round(o_totalprice % 60, 2) END AS cloud, 'T' || (o_custkey % 5) AS mgrs, year(o_orderdate)::INT AS year FROM orders WHERE {_READABLE} AND ({meets})),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY cloud, id) AS nth FROM s WHERE year BETWEEN {start} AND {end} AND cloud < {limit})
SELECT id, date, round(cloud, 2) AS cloud, mgrs, year FROM r WHERE nth <= 300"""


def _folder(spark, sf_dir) -> str:
    path = scratch_path(spark, "features")
    features(spark, sf_dir).select(F.col("feature").alias("value"), "year").write.partitionBy("year").text(path)
    return path


@query(_search_sql(1993, 1995, 20.0))
def q_scene_search(spark, sf_dir):
    """A search of the catalog's files: only the years asked for are listed, and of each only the least clouded scenes count."""
    return files.search_scenes(spark, _folder(spark, sf_dir), 1993, 1995).select("id", "date", rounded("cloud", 2).alias("cloud"), "mgrs", "year")


@query(_search_sql(1994, 1997, 45.0))
def q_scene_search_relaxed(spark, sf_dir):
    """A limit that nothing passes, not even a scene without cloud, gives way to the relaxed one."""
    out = files.search_scenes(spark, _folder(spark, sf_dir), 1994, 1997, max_cloud=-math.inf)
    return out.select("id", "date", rounded("cloud", 2).alias("cloud"), "mgrs", "year")


@query(_search_sql(1993, 1997, 20.0, "o_orderkey % 3 = 0 OR o_orderkey % 50 BETWEEN 8 AND 12"))
def q_scene_search_box(spark, sf_dir):
    """Scenes that meet a box, and those that state no bounds."""
    out = files.search_scenes(spark, _folder(spark, sf_dir), 1993, 1997, box=(10.0, 0.5, 12.0, 2.0))
    return out.select("id", "date", rounded("cloud", 2).alias("cloud"), "mgrs", "year")


# ---- choice -------------------------------------------------------------------------------------------------------------------------------------

#: A few tiles with gaps: T0 lacks a year, T1 has scenes out of season only in another.
_FEW = "(SELECT * FROM s0 WHERE NOT (mgrs = 'T0' AND year = 1994) AND NOT (year = 1995 AND doy NOT BETWEEN 200 AND 230) AND year <> 1997)"
_FEW_SQL = pseudo.SCENES_SQL.replace("s AS (", "s0 AS (", 1) + f", s AS {_FEW}"


def _few(spark, sf_dir) -> DataFrame:
    return pseudo.scenes(spark, sf_dir).where("NOT (mgrs = 'T0' AND year = 1994) AND NOT (year = 1995 AND doy NOT BETWEEN 200 AND 230) AND year <> 1997")


@query(f"WITH {_FEW_SQL}, y AS (SELECT DISTINCT year FROM s), t AS (SELECT DISTINCT mgrs FROM s) SELECT mgrs, list_sort(list(year) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.mgrs = t.mgrs AND s.year = y.year)))::VARCHAR AS missed FROM t, y GROUP BY mgrs")
def q_missed_years(spark, sf_dir):
    years = F.when(F.size("missed") > 0, F.concat(F.lit("["), F.concat_ws(", ", F.transform("missed", lambda y: y.cast("string"))), F.lit("]")))
    return scenes.missed_years(_few(spark, sf_dir)).select("mgrs", years.alias("missed"))


def _best_sql(base: str) -> str:
    return f"""{base},
an AS (SELECT a, year, min(cloud) AS cloud FROM s, range(15, 366, 10) t(a) WHERE least(abs(doy - a) % 365, 365 - abs(doy - a) % 365) <= 45 GROUP BY ALL),
ag AS (SELECT a, count(*) AS covered, list_sort(list(cloud))[count(*) // 2 + 1] AS med FROM an GROUP BY a),
anchor AS (SELECT a::INT AS anchor FROM ag ORDER BY covered DESC, med, a LIMIT 1),
rank AS (SELECT mgrs, count(*) AS n, count(DISTINCT year) AS y FROM s GROUP BY mgrs ORDER BY y DESC, n DESC, mgrs LIMIT 1),
tile AS (SELECT mgrs FROM rank WHERE y >= (SELECT count(DISTINCT year) FROM s)),
d AS (SELECT s.*, least(abs(doy - anchor) % 365, 365 - abs(doy - anchor) % 365) AS days FROM s, anchor),
f AS (SELECT *, (days > 45)::INT AS tier, (mgrs IN (SELECT mgrs FROM tile))::INT AS own FROM d WHERE days <= 90),
b0 AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY tier, own DESC, round_even(cloud, 1), days, id) AS nth FROM f),
b AS (SELECT * FROM b0 WHERE nth = 1)"""


@query(f"WITH {_best_sql(_FEW_SQL)} SELECT y::INT AS year, CASE WHEN tier IS NULL THEN 'missing' ELSE 'relaxed' END AS reason FROM range(1990, 2000) t(y) LEFT JOIN b ON b.year = y WHERE tier IS NULL OR tier = 1")
def q_rejected_years(spark, sf_dir):
    """Years without a scene and those whose only scenes lie out of season."""
    return scenes.rejected(scenes.best_per_year(_few(spark, sf_dir)), 1990, 1999)


@query(f"WITH {_best_sql(_FEW_SQL)} SELECT array_to_string(list_sort(list(DISTINCT mgrs)), ' ') AS tiles FROM b")
def q_selected_tiles(spark, sf_dir):
    return scenes.tiles(scenes.best_per_year(_few(spark, sf_dir))).select(F.concat_ws(" ", "tiles").alias("tiles"))


def _notes_sql(base: str) -> str:
    return f"""WITH {_best_sql(base)}, m AS (SELECT list_sort(list(DISTINCT year)) AS ys FROM s WHERE year NOT IN (SELECT year FROM s WHERE mgrs = (SELECT mgrs FROM rank))),
tl AS (SELECT list_sort(list(DISTINCT mgrs)) AS ts FROM b),
n AS (SELECT 1 AS i, 'All dates lie near ' || strftime(DATE '2024-01-01' + (anchor - 1), '%d %B') || ' (at most 45 days off where possible), so plants and sun are alike.' AS note FROM anchor
UNION ALL SELECT 2, 'No tile covers all years (the best one misses ' || array_to_string(ys, ', ') || '), so each year has its clearest tile.' FROM m WHERE len(ys) > 0
UNION ALL SELECT 3, CASE WHEN len(ts) = 1 THEN 'All dates come from tile ' || ts[1] || '.' ELSE 'The dates come from the tiles ' || array_to_string(ts, ', ') || '.' END FROM m, tl WHERE ys IS NULL OR len(ys) = 0)
SELECT note FROM n"""


@query(_notes_sql(_FEW_SQL))
def q_selection_notes(spark, sf_dir):
    s = _few(spark, sf_dir)
    return scenes.selection_notes(s, scenes.best_per_year(s)).select(F.explode("notes").alias("note"))


@query(_notes_sql(pseudo.SCENES_SQL))
def q_selection_notes_whole(spark, sf_dir):
    s = pseudo.scenes(spark, sf_dir)
    return scenes.selection_notes(s, scenes.best_per_year(s)).select(F.explode("notes").alias("note"))


@query("SELECT DISTINCT dayofyear(o_orderdate)::INT AS doy, strftime(DATE '2024-01-01' + (dayofyear(o_orderdate) - 1)::INT, '%d %B') AS label FROM orders")
def q_anchor_label(spark, sf_dir):
    return pseudo.table(spark, sf_dir, "orders").select(F.dayofyear("o_orderdate").alias("doy")).distinct().select("doy", scenes.anchor_label(F.col("doy")).alias("label"))


# ---- places -------------------------------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal / 200 AS lat, (c_custkey * 37 % 340) - 170.0::DOUBLE AS lon FROM customer),
b AS (SELECT k, lon, lat, CASE WHEN k % 3 = 0 THEN lon - 0.08::DOUBLE ELSE lon - 0.1::DOUBLE END AS w, CASE WHEN k % 3 = 0 THEN lon + 0.08::DOUBLE ELSE lon + 0.3::DOUBLE END AS e, CASE WHEN k % 3 = 0 THEN lat - 0.08::DOUBLE ELSE lat - 0.05::DOUBLE END AS s, CASE WHEN k % 3 = 0 THEN lat + 0.08::DOUBLE ELSE lat + 0.002::DOUBLE END AS n FROM a)
SELECT 'Town ' || k AS query, CASE WHEN k % 4 = 0 THEN NULL ELSE 'Town ' || k || ', Land' END AS label, CASE WHEN k % 4 <> 0 THEN round(lon, 5) END AS lon, CASE WHEN k % 4 <> 0 THEN round(lat, 5) END AS lat, CASE WHEN k % 4 <> 0 THEN round(w, 5) END AS w, CASE WHEN k % 4 <> 0 THEN round(s, 5) END AS s,
  CASE WHEN k % 4 <> 0 THEN round(e, 5) END AS e, CASE WHEN k % 4 <> 0 THEN round(n, 5) END AS n, CASE WHEN k % 4 <> 0 THEN 'geocoder' END AS source FROM b
UNION ALL SELECT 'Kokapet, Hyderabad', 'Kokapet, Hyderabad, India', 78.3378, 17.4045, 78.29, 17.36, 78.39, 17.44, 'gazetteer'""")
def q_geocode(spark, sf_dir):
    """Customers as towns: a quarter are unknown to the geocoder, a third have an answer without a box; one name is in the gazetteer."""
    k, lat, lon = F.col("c_custkey"), F.col("c_acctbal") / 200, (F.col("c_custkey") * 37 % 340) - 170.0
    c = pseudo.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Town "), k.cast("string"))
    names = c.select(name.alias("query")).unionByName(spark.createDataFrame([("Kokapet, Hyderabad",)], "query string"))
    text = lambda x: x.cast("string")
    box = F.when(k % 3 != 0, F.array(text(lat - 0.05), text(lat + 0.002), text(lon - 0.1), text(lon + 0.3)))
    answers = c.where(k % 4 != 0).select(F.lower(name).alias("query"), text(lat).alias("lat"), text(lon).alias("lon"), box.alias("boundingbox"), F.concat(name, F.lit(", Land")).alias("display_name"))
    path = scratch_path(spark, "answers")
    answers.write.json(path)
    out = files.geocode(names, spark.read.schema(files.GEOCODER).json(path))
    return out.select("query", "label", rounded("lon", 5).alias("lon"), rounded("lat", 5).alias("lat"), *(rounded(f"box.{s}", 5).alias(s) for s in "wsen"), "source")


@query("""WITH n AS (SELECT n_name, n_nationkey::DOUBLE AS k FROM nation WHERE n_nationkey % 4 < 3),
r AS (SELECT n_name, 0 AS p, k, k AS y FROM n UNION ALL SELECT n_name, 1, k + 20, k + 3 FROM n WHERE k % 4 = 1)
SELECT n_name AS name, round(sum(x0), 3) AS x0, round(sum(y0), 3) AS y0, round(sum(x1), 3) AS x1, round(sum(y1), 3) AS y1, count(*) AS edges FROM (
  SELECT n_name, unnest([k, k + 2, k + 2, k, k]) AS x0, unnest([y, y, y + 1, y + 1, y]) AS y0, unnest([k + 2, k + 2, k, k, k]) AS x1, unnest([y, y + 1, y + 1, y, y]) AS y1 FROM r) GROUP BY n_name""")
def q_boundary_edges(spark, sf_dir):
    """Nations as boundaries: a polygon with a hole, a multi-polygon, a collection; one in four is no shape at all."""
    k = F.col("n_nationkey")
    point = lambda x, y: F.format_string("[%s,%s]", (k + x).cast("string"), (k + y).cast("string"))
    ring = lambda x, y: F.concat(F.lit("["), F.concat_ws(",", point(x, y), point(x + 2, y), point(x + 2, y + 1), point(x, y + 1), point(x, y)), F.lit("]"))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring(0, 0), F.lit(",[[0,0],[1,0],[1,1],[0,0]]]}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring(0, 0), F.lit("],["), ring(20, 3), F.lit("],[[[1,1],[2,2],[1,1]]]]}"))
    several = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), polygon, F.lit(',{"type":"Point","coordinates":[1,2]}]}'))
    shape = F.when(k % 4 == 0, polygon).when(k % 4 == 1, multi).when(k % 4 == 2, several).otherwise(F.lit(json.dumps({"type": "Point", "coordinates": [0, 0]})))
    path = scratch_path(spark, "boundaries")
    pseudo.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), shape.alias("geojson")).write.json(path)
    edges = files.boundary_edges(spark.read.schema(files.BOUNDARY).json(path))
    return edges.groupBy("name").agg(*(rounded(F.sum(c), 3).alias(c) for c in ("x0", "y0", "x1", "y1")), F.count("*").alias("edges"))


def _spans(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    w, s = (k * 37 % 300) - 150.0, (k * 11 % 120) - 60.0
    return pseudo.table(spark, sf_dir, "customer").select("c_custkey", w.alias("w"), s.alias("s"), (w + (k % 9) * 0.3).alias("e"), (s + (k % 7) * 0.35).alias("n"))


_SPANS = "b AS (SELECT c_custkey, w, s, w + (c_custkey % 9) * 0.3::DOUBLE AS e, s + (c_custkey % 7) * 0.35::DOUBLE AS n FROM (SELECT c_custkey, (c_custkey * 37 % 300) - 150.0::DOUBLE AS w, (c_custkey * 11 % 120) - 60.0::DOUBLE AS s FROM customer))"


@query(f"""WITH {_SPANS}, t AS (SELECT *, CASE WHEN greatest(e - w, n - s) >= 0.40 THEN least(CASE WHEN c_custkey % 3 = 0 THEN {SETTINGS.grid_size} ELSE 200 * (c_custkey % 3) END, 420) WHEN c_custkey % 3 = 0 THEN {SETTINGS.grid_size} ELSE 200 * (c_custkey % 3) END AS target, e - w AS dx, n - s AS dy FROM b)
SELECT c_custkey, (dx >= 2 OR dy >= 2) AS country, target::INT AS target, CASE WHEN dx > 0 AND dy > 0 THEN CASE WHEN dx >= dy THEN target ELSE greatest(64, round_even(target * dx / dy, 0)) END ELSE 0 END::INT AS width,
  CASE WHEN dx > 0 AND dy > 0 THEN CASE WHEN dx >= dy THEN greatest(64, round_even(target * dy / dx, 0)) ELSE target END ELSE 0 END::INT AS height, round(dx * 111.32::DOUBLE, 6) AS wide, round(dy * 110.57::DOUBLE, 6) AS high, round_even(dx * 111.32::DOUBLE * (dy * 110.57::DOUBLE), 1) AS area FROM t""")
def q_area_grid(spark, sf_dir):
    """Whether a box is country-sized, its grid (none without width or height) and its size in kilometres."""
    rows, sides = _spans(spark, sf_dir), [F.col(c) for c in "wsen"]
    wanted = F.when(F.col("c_custkey") % 3 != 0, 200 * (F.col("c_custkey") % 3)).cast("int")
    rows = rows.withColumn("target", places.grid_target(*sides, wanted))
    rows = rows.withColumns({"g": places.grid_size(*sides, F.col("target")), "km": places.box_km(*sides), "country": study.is_country_scale(*sides)})
    return rows.select("c_custkey", "country", "target", *(F.coalesce(f"g.{c}", F.lit(0)).alias(c) for c in ("width", "height")), rounded("km.wide").alias("wide"), rounded("km.high").alias("high"), F.col("km.area").alias("area"))


@query("SELECT c_custkey, round(x - 0.06::DOUBLE, 5) AS w, round(y - 0.06::DOUBLE, 5) AS s, round(x + 0.06::DOUBLE, 5) AS e, round(y + 0.06::DOUBLE, 5) AS n FROM (SELECT c_custkey, (c_custkey * 37 % 340) - 170.0::DOUBLE AS x, c_acctbal / 200 AS y FROM customer)")
def q_point_box(spark, sf_dir):
    rows = pseudo.table(spark, sf_dir, "customer").select("c_custkey", places.point_box((F.col("c_custkey") * 37 % 340) - 170.0, F.col("c_acctbal") / 200).alias("b"))
    return rows.select("c_custkey", *(rounded(f"b.{c}", 5).alias(c) for c in "wsen"))
