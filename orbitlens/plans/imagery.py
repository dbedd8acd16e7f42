"""Queries on reading images onto a grid, and on colours and pictures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import HEAT_STOPS, INDEX_META, MASK_ALPHA, NO_DATA_HEAT, OVERLAY_COLOURS, SCL_COLOURS, SCL_DEGRADED, SCL_INVALID, SCL_LABELS
from ..functions import indices as ix
from ..functions.projection import project
from ..operators import detect, raster
from ..sources import archive as archives
from ..sources import files
from . import pseudo
from .registry import KEYS, labelled_sql, nd_sql, query, rounded, scored_sql, with_sql

COLOURS = raster.COLOURS

# ---- projection and warp ------------------------------------------------------------------------------------------------------------------------

_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_T = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * math.sqrt(_N) / (1 + _N)


def _utm_sql(lon: str, lat: str, zone: str, source: str, keep: str) -> str:
    """Common table expressions that add e and n, easting and northing, to the rows of `source`."""
    east = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_T, 1))])
    north = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_T, 1))])
    return f"""u1 AS (SELECT {keep}, radians({lon} - ({zone} * 6 - 183)) AS dl, sinh(atanh(sin(radians({lat}))) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin(radians({lat})))) AS t FROM {source}),
u2 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM u1),
u3 AS (SELECT *, 500000 + {_A!r}::DOUBLE * ({east}) AS e, {_A!r}::DOUBLE * ({north}) AS n FROM u2)"""


@query(f"""WITH p AS (SELECT c_custkey AS k, (c_custkey % 60) + 1 AS zone, (c_custkey % 60) * 6 - 177 + (c_custkey % 7) * 0.9::DOUBLE - 2.7::DOUBLE AS lon, c_acctbal / 150 AS lat FROM customer),
{_utm_sql("lon", "lat", "zone", "p", "k, lon, lat")}
SELECT k, CASE WHEN k % 4 = 0 THEN round(lon, 4) WHEN k % 4 = 3 THEN NULL ELSE round(e, 3) END AS x, CASE WHEN k % 4 = 0 THEN round(lat, 4) WHEN k % 4 = 3 THEN NULL WHEN k % 4 = 2 THEN round(n + 10000000, 3) ELSE round(n, 3) END AS y FROM u3""")
def q_project(spark, sf_dir):
    """Points in degrees, in zones north and south of the equator, and in a reference system that is none of them."""
    k = F.col("c_custkey")
    zone = (k % 60) + 1
    epsg = F.when(k % 4 == 0, 4326).when(k % 4 == 1, 32600 + zone).when(k % 4 == 2, 32700 + zone).otherwise(3857)
    lon, lat = (k % 60) * 6 - 177 + (k % 7) * 0.9 - 2.7, F.col("c_acctbal") / 150
    x, y = project(lon, lat, epsg.cast("int"))
    digits = lambda c: F.when(k % 4 == 0, F.round(c, 4)).otherwise(F.round(c, 3))
    return pseudo.table(spark, sf_dir, "customer").select(k.alias("k"), digits(x).alias("x"), digits(y).alias("y"))


#: A box in UTM zone 44 north whose pixels are dealt over two scenes, the second of which fills the first one's hole.
_BOX = (80.5037, 16.4521, 80.5113, 16.4589)
_X0, _Y0, _SIDE = 553700.0, 1820150.0, 20.0


def _raw(spark, sf_dir) -> DataFrame:
    """Raw numbers (scene_id, level, r, c, bands, scl) of three epochs of the pseudo-raster, each with a companion."""
    px = pseudo.pixels(spark, sf_dir).where("k < 3").withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    hole = (F.col("ord") == 0) & ((F.col("r") * 3 + F.col("c")) % 11 < 2)
    lifted = F.when((F.col("k") == 1), 1000).otherwise(0) + F.col("ord") * 10
    number = lambda b: F.when(hole, 0).otherwise(F.greatest(F.lit(1), F.round(F.col(b) * 10000)).cast("int") + lifted).cast("int")
    bands = {"red": "red", "green": "green", "blue": "green", "nir": "nir", "swir16": "swir16"}
    return px.select(F.format_string("S%d-%d", "k", "ord").alias("scene_id"), F.lit(1).alias("level"), "r", "c", *(number(b).alias(name) for name, b in bands.items()), F.when(hole, 0).otherwise(F.col("scl")).alias("scl"), "k", "ord")


_RAW_SQL = """raw AS (SELECT k::INT AS k, ord, r, c, CASE WHEN hole THEN 0 ELSE greatest(1, round(red * 10000)) + lift END AS red, CASE WHEN hole THEN 0 ELSE greatest(1, round(nir * 10000)) + lift END AS nir,
  CASE WHEN hole THEN 0 ELSE greatest(1, round(swir16 * 10000)) + lift END AS swir16, CASE WHEN hole THEN 0 ELSE greatest(1, round(green * 10000)) + lift END AS green, CASE WHEN hole THEN 0 ELSE scl END AS scl
  FROM (SELECT px.*, ord, ord = 0 AND (r * 3 + c) % 11 < 2 AS hole, CASE WHEN k = 1 THEN 1000 ELSE 0 END + ord * 10 AS lift FROM px, (VALUES (0), (1)) t(ord) WHERE k < 3))"""
_CELLS_SQL = f"""cell AS (SELECT (i // 17)::INT AS tr, (i % 17)::INT AS tc, {_BOX[0]}::DOUBLE + (i % 17 + 0.5::DOUBLE) / 17 * {_BOX[2] - _BOX[0]!r}::DOUBLE AS lon, {_BOX[3]}::DOUBLE - (i // 17 + 0.5::DOUBLE) / 15 * {_BOX[3] - _BOX[1]!r}::DOUBLE AS lat FROM range(255) t(i)),
{_utm_sql("lon", "lat", "44", "cell", "tr, tc")},
plc AS (SELECT tr, tc, (e - {_X0}::DOUBLE) / {_SIDE} - 0.5::DOUBLE AS x, ({_Y0}::DOUBLE - n) / {_SIDE} - 0.5::DOUBLE AS y FROM u3)"""
_LOAD_SQL = f"""{_RAW_SQL}, {_CELLS_SQL},
w AS (SELECT k, ord, tr, tc, raw.*, (1 - abs(y - raw.r)) * (1 - abs(x - raw.c)) AS w, raw.r = floor(y + 0.5::DOUBLE) AND raw.c = floor(x + 0.5::DOUBLE) AS mid FROM plc JOIN raw ON abs(y - raw.r) < 1 AND abs(x - raw.c) < 1),
m AS (SELECT k, ord, tr, tc, {", ".join(f"coalesce(floor(sum(w * {b}) FILTER ({b} <> 0) / sum(w) FILTER ({b} <> 0) + 0.5::DOUBLE), 0) AS {b}" for b in ("red", "green", "nir", "swir16"))}, coalesce(max(scl) FILTER (mid), 0) AS scl FROM w GROUP BY ALL),
d AS (SELECT k, tr, tc, coalesce(min(ord) FILTER (swir16 > 0), min(ord)) AS pick FROM m GROUP BY ALL),
f AS (SELECT ks.k, plc.tr, plc.tc, coalesce(pick, 0) AS pick, {", ".join(f"coalesce(m.{b}, 0) AS {b}" for b in ("red", "green", "nir", "swir16", "scl"))} FROM (SELECT DISTINCT k FROM raw) ks CROSS JOIN plc LEFT JOIN d ON d.k = ks.k AND d.tr = plc.tr AND d.tc = plc.tc LEFT JOIN m ON m.k = ks.k AND m.tr = plc.tr AND m.tc = plc.tc AND m.ord = pick),
p AS (SELECT k, CASE WHEN count(*) FILTER (swir16 > 0) > 64 AND quantile_cont(swir16, 0.01::DOUBLE) FILTER (swir16 > 0) >= 700 THEN 1000 ELSE 0 END AS pedestal FROM f GROUP BY k),
z AS (SELECT f.*, pedestal, scl NOT IN {SCL_INVALID} AND NOT (red = 0 AND green = 0 AND nir = 0 AND swir16 = 0) AS valid FROM f JOIN p USING (k))"""


def _loaded(spark, sf_dir) -> DataFrame:
    raw = _raw(spark, sf_dir)
    h = pseudo.side(spark, sf_dir)
    prints = raw.select("scene_id", "level").distinct().select("scene_id", "level", F.lit(32644).alias("epsg"), F.lit(_X0).alias("x0"), F.lit(_Y0).alias("y0"), F.lit(_SIDE).alias("dx"), F.lit(_SIDE).alias("dy"), F.lit(h).alias("rows"), F.lit(h).alias("cols"))
    none = spark.createDataFrame([], "x int")
    archive = archives.Archive(none, prints, raw.drop("k", "ord"), none, none, none)
    wanted = spark.createDataFrame([(k, o, f"S{k}-{o}") for k in range(3) for o in range(2)], "k int, ord int, scene_id string")
    return archives.load_epochs(archive, wanted, _BOX, 15, 17)


@query(with_sql(pseudo.SQL, f", {_LOAD_SQL} SELECT k, tr AS r, tc AS c, {', '.join(f'round(greatest(0, least(1.6::DOUBLE, ({b} - pedestal) * 0.0001::DOUBLE)), 6) AS {b}' for b in ('red', 'green', 'nir', 'swir16'))}, scl::INT AS scl, valid, scl IN {SCL_DEGRADED} AS degraded, pick > 0 AS filled, pedestal FROM z"))
def q_epoch_load(spark, sf_dir):
    """Epochs read from raw images in metres onto a grid in degrees: warped, holes filled from a companion, one epoch's offset taken off, pixels judged."""
    out = _loaded(spark, sf_dir)
    return out.select("k", "r", "c", *(rounded(b).alias(b) for b in ("red", "green", "nir", "swir16")), "scl", "valid", "degraded", "filled", "pedestal")


@query(with_sql(pseudo.SQL, f", {_LOAD_SQL} SELECT k, round(avg(valid::INT), 6) AS valid_fraction, round(avg((scl IN {SCL_DEGRADED})::INT), 6) AS degraded_fraction, round(avg((pick > 0)::INT), 6) AS filled_fraction, max(pedestal) AS pedestal FROM z GROUP BY k"))
def q_epoch_quality(spark, sf_dir):
    out = archives.epoch_quality(_loaded(spark, sf_dir))
    return out.select("k", *(rounded(f"{c}_fraction").alias(f"{c}_fraction") for c in ("valid", "degraded", "filled")), "pedestal")


@query(with_sql(pseudo.SQL, """, b AS (SELECT k, r // 2 AS r, c // 2 AS c, avg(CASE WHEN (r + c) % 5 <> 0 THEN round(red * 10000) END) AS red, arg_min(scl, r * 100000 + c) AS scl FROM px WHERE k < 2 GROUP BY ALL)
SELECT 'S' || k AS scene_id, r, c, round(coalesce(red, 0), 6) AS red, scl FROM b"""))
def q_pyramid_level(spark, sf_dir):
    """The second level of a written pyramid: means without the pixels of no data; other levels' files are not opened."""
    from ..scratch import scratch_path

    px = pseudo.pixels(spark, sf_dir, in_order=True).where("k < 2").select("aoi", F.concat(F.lit("S"), F.col("k").cast("string")).alias("scene_id"), "r", "c", F.when((F.col("r") + F.col("c")) % 5 != 0, F.round(F.col("red") * 10000)).otherwise(0).alias("red"), "scl")
    path = scratch_path(spark, "pyramid")
    files.write_pyramid(px, path, (1, 2, 4), ("red",))
    return files.read_pyramid(spark, path, 2).select("scene_id", "r", "c", rounded("red").alias("red"), "scl")


# ---- indices ------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '{f}', '{b}')" for k, (n, f, b) in INDEX_META.items()) + ") t(\"index\", name, formula, bands)")
def q_index_meta(spark, sf_dir):
    return ix.index_table(spark)


@query(with_sql(pseudo.SQL, f"SELECT k, r, c, round(CASE k % 4 WHEN 0 THEN {nd_sql('NDVI')} WHEN 1 THEN {nd_sql('NDBI')} WHEN 2 THEN {nd_sql('MNDWI')} ELSE {nd_sql('NBR')} END, 6) AS value FROM px"))
def q_index_dispatch(spark, sf_dir):
    """Each epoch by another index, named in any case."""
    by_name = F.when(F.col("k") % 4 == 0, ix.index("ndvi")).when(F.col("k") % 4 == 1, ix.index("Ndbi")).when(F.col("k") % 4 == 2, ix.index("MNDWI")).otherwise(ix.index("nbr"))
    return pseudo.pixels(spark, sf_dir).select("k", "r", "c", rounded(by_name).alias("value"))


@query(with_sql(scored_sql("urban_expansion"), "SELECT r, c, TRUE AS allowed FROM cd"))
def q_gate_other(spark, sf_dir):
    """A kind of change without a gate of its own: everything is plausible."""
    return detect.candidates(pseudo.pixels(spark, sf_dir), "urban_expansion").select("r", "c", ix.gate("snow_melt").alias("allowed"))


# ---- colours ------------------------------------------------------------------------------------------------------------------------------------


@query(with_sql(scored_sql("vegetation_loss"), """, q AS (SELECT quantile_cont(-delta, 0.02::DOUBLE) AS lo, quantile_cont(-delta, 0.99::DOUBLE) AS hi FROM sc)
SELECT heat, count(*) AS n FROM (SELECT floor(255 * greatest(0::DOUBLE, least(1::DOUBLE, (-delta - lo) / greatest(hi - lo, 1e-6::DOUBLE))))::INT AS heat FROM sc, q) GROUP BY heat"""))
def q_heat_bins(spark, sf_dir):
    rows = detect.scored(detect.pair(pseudo.pixels(spark, sf_dir)), "vegetation_loss")
    return raster.heat_index(rows, "delta", "decrease").groupBy("heat").agg(F.count("*").alias("n"))


def _mix_sql(i: int) -> str:
    cases = " ".join(f"WHEN t <= {t1}::DOUBLE THEN floor({c0[i]} + (t - {t0}::DOUBLE) / {t1 - t0!r}::DOUBLE * {c1[i] - c0[i]} + 1e-9::DOUBLE)" for (t0, c0), (t1, c1) in zip(HEAT_STOPS, HEAT_STOPS[1:], strict=False))
    return f"CASE {cases} ELSE {HEAT_STOPS[-1][1][i]} END::INT"


@query(f"SELECT heat::INT AS heat, {', '.join(f'{_mix_sql(i)} AS {b}' for i, b in enumerate(COLOURS))} FROM (SELECT heat, heat / 255.0::DOUBLE AS t FROM range(256) x(heat)) UNION ALL SELECT -1, {NO_DATA_HEAT}, {NO_DATA_HEAT}, {NO_DATA_HEAT}")
def q_heat_colours(spark, sf_dir):
    heat = F.when(F.col("id") < 256, F.col("id").cast("int"))
    return spark.range(257).select(F.coalesce(heat, F.lit(-1)).alias("heat"), *(c.alias(b) for b, c in zip(COLOURS, raster.heat_colours(heat), strict=True)))


_VEG = scored_sql("vegetation_loss") + """, dl AS (SELECT r, c, raw - s AS delta, valid FROM (SELECT r, c, valid, {a} - {b} AS raw FROM both_), (SELECT any_value(shift) AS s FROM cd)),
q AS (SELECT quantile_cont(-delta, 0.02::DOUBLE) FILTER (valid) AS lo, quantile_cont(-delta, 0.99::DOUBLE) FILTER (valid) AS hi FROM dl),
hx AS (SELECT r, c, floor(255 * greatest(0::DOUBLE, least(1::DOUBLE, (-delta - lo) / (hi - lo))))::INT / 255.0::DOUBLE AS t FROM dl, q WHERE valid)""".format(a=nd_sql("NDVI", "_a"), b=nd_sql("NDVI", "_b"))


@query(with_sql(_VEG, f", gd AS (SELECT y.i::INT AS r, x.i::INT AS c FROM hh, range(h) y(i), range(h) x(i)) SELECT gd.r, gd.c, {', '.join(f'CASE WHEN t IS NULL THEN {NO_DATA_HEAT} ELSE {_mix_sql(i)} END AS {b}' for i, b in enumerate(COLOURS))} FROM gd LEFT JOIN hx USING (r, c)"))
def q_heat_png(spark, sf_dir):
    """The heat map of a change, written as an image and read back."""
    frame = pseudo.frame(spark, sf_dir)
    both = detect.kept(detect.pair(pseudo.pixels(spark, sf_dir)))
    shift = detect.scored(both, "vegetation_loss").groupBy("aoi").agg(F.first("shift").alias("shift"))
    moved = both.join(shift, "aoi").withColumn("delta", ix.index("NDVI", "_a") - ix.index("NDVI", "_b") - F.col("shift"))
    image = raster.heat_png(raster.heat_index(moved, "delta", "decrease"), frame.height, frame.width, 1)
    return raster.png_pixels(image).select("r", "c", *COLOURS)


_SHADE = "floor(255 * greatest(0::DOUBLE, least(1::DOUBLE, {b} * 2)))::INT"


@query(with_sql(labelled_sql("urban_expansion"), f""", inner_ AS (SELECT a.r, a.c FROM lab a JOIN lab b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 9),
sh AS (SELECT r, c, {", ".join(f"{_SHADE.format(b=b)} AS {n}" for n, b in (("red", "red"), ("green", "green"), ("blue", "green")))} FROM px, ends WHERE k = k1),
gd AS (SELECT y.i::INT AS r, x.i::INT AS c FROM hh, range(h) y(i), range(h) x(i))
SELECT gd.r, gd.c, {", ".join(f"CASE WHEN sh.red IS NULL THEN 28 WHEN lab.label IS NOT NULL AND inner_.r IS NULL THEN 255 WHEN lab.label IS NOT NULL THEN floor(sh.{n} * (1 - 0.62::DOUBLE) + {v} * 0.62::DOUBLE + 1e-9::DOUBLE)::INT ELSE sh.{n} END AS {n}" for n, v in zip(COLOURS, OVERLAY_COLOURS["increase"], strict=True))}
FROM gd LEFT JOIN sh USING (r, c) LEFT JOIN lab USING (r, c) LEFT JOIN inner_ USING (r, c)"""))
def q_overlay_png(spark, sf_dir):
    """Changed ground tinted over the last image, its edge white; written as an image and read back."""
    px, frame = detect.kept(pseudo.pixels(spark, sf_dir)), pseudo.frame(spark, sf_dir)
    labels = detect.kept(detect.labelled(detect.candidates(px, "urban_expansion"), frame))
    last = px.join(px.groupBy("aoi").agg(F.max("k").alias("k")), ["aoi", "k"])
    shade = lambda b: F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(b) * 2))).cast("int")
    colours = raster.overlay(last.select(*KEYS, shade("red").alias("red"), shade("green").alias("green"), shade("green").alias("blue")), labels, "increase")
    return raster.png_pixels(raster.rgb_png(colours, frame.height, frame.width, 1)).select("r", "c", *COLOURS)


@query(with_sql(labelled_sql("urban_expansion"), f""", gd AS (SELECT y.i::INT AS r, x.i::INT AS c FROM hh, range(3 * h) y(i), range(3 * h) x(i))
SELECT gd.r, gd.c, {", ".join(f"CASE WHEN label IS NULL THEN 0 ELSE {v} END AS {n}" for n, v in zip((*COLOURS, "alpha"), (*OVERLAY_COLOURS["decrease"], MASK_ALPHA), strict=True))} FROM gd LEFT JOIN lab ON lab.r = gd.r // 3 AND lab.c = gd.c // 3"""))
def q_mask_png(spark, sf_dir):
    """The change mask as a transparent image of three times its size, read back."""
    frame = pseudo.frame(spark, sf_dir)
    px = pseudo.pixels(spark, sf_dir)
    labels = detect.labelled(detect.candidates(px, "urban_expansion"), frame)
    return raster.png_pixels(raster.masks_png(px, labels, "decrease", frame.height, frame.width, 3 * frame.height)).select("r", "c", *COLOURS, "alpha")


@query(with_sql(pseudo.SQL, f""", gd AS (SELECT y.i::INT AS r, x.i::INT AS c FROM hh, range(h) y(i), range(h) x(i)), z AS (SELECT r, c, scl FROM px WHERE k = 3)
SELECT gd.r, gd.c, {", ".join(f"coalesce([{', '.join(str(x[i]) for x in SCL_COLOURS)}][scl + 1], 0) AS {b}" for i, b in enumerate(COLOURS))} FROM gd LEFT JOIN z USING (r, c)"""))
def q_class_png(spark, sf_dir):
    """The map of an epoch's classes, written as an image and read back."""
    frame = pseudo.frame(spark, sf_dir)
    image = raster.class_png(pseudo.pixels(spark, sf_dir).where("k = 3"), frame.height, frame.width, 1)
    return raster.png_pixels(image).select("r", "c", *COLOURS)


@query("SELECT scl::INT AS scl, label, red, green, blue FROM (VALUES " + ", ".join(f"({i}, '{SCL_LABELS[i]}', {r}, {g}, {b})" for i, (r, g, b) in enumerate(SCL_COLOURS)) + ") t(scl, label, red, green, blue)")
def q_class_colours(spark, sf_dir):
    scl = F.col("id").cast("int")
    label = F.get(F.array(*(F.lit(x) for x in SCL_LABELS)), scl)
    return spark.range(len(SCL_LABELS)).select(scl.alias("scl"), label.alias("label"), *(c.alias(b) for b, c in zip(COLOURS, raster.class_colours(scl), strict=True)))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE round_even(p_retailprice / 7, 2) END AS price, round_even(p_size / 8.0::DOUBLE, 1) AS size FROM part")
def q_display_rounding(spark, sf_dir):
    """Numbers as results show them: half to even, and none that JSON can't hold."""
    from ..operators import report

    price = F.when(F.col("p_partkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") / 7)
    rows = pseudo.table(spark, sf_dir, "part").select("p_partkey", price.alias("area_ha"), (F.col("p_size") / 8).alias("pixel_size_m"))
    shown = report.display(rows.withColumnRenamed("area_ha", "changed_area_ha"))
    return shown.select("p_partkey", F.col("changed_area_ha").alias("price"), F.col("pixel_size_m").alias("size"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS safe FROM documents
UNION ALL SELECT page_id + 1000000, md5(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) FROM pages""")
def q_escape(spark, sf_dir):
    rows = pseudo.table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(pseudo.table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000).alias("doc_id"), F.col("html").alias("text")))
    return rows.select("doc_id", F.md5(ix.escaped(F.col("text")).cast("binary")).alias("safe"))
