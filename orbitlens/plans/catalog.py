"""Query catalogue of the change-detection operators, each with an independent SQL oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import GAZETTEER, MODES, MOVES, SCL_DEGRADED, SCL_INVALID, SIGNATURE_WEIGHTS
from ..functions import indices as ix
from ..operators import detect, interpret, neighbourhood, places, raster, report, scenes, signatures, study
from ..sources import files
from ..streaming.epochs import fold_events
from . import pseudo
from .registry import BANDS_OF, CLUSTERS_SQL, KEYS, ORACLES, PERSIST_SQL, QUERIES, TODAY, WET_A, WET_B, S, labelled_sql, nd_sql, query, rounded, scored_sql, with_sql

# ---- pixels ----------------------------------------------------------------------------------------------------------------------------------


@query(with_sql(pseudo.SQL, "SELECT k, year, r, c, round(nir, 6) AS nir, round(red, 6) AS red, round(swir16, 6) AS swir16, round(green, 6) AS green, scl, valid FROM px"))
def q_pixel_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pseudo.pixels(spark, sf_dir)
    return px.select("k", "year", "r", "c", *(rounded(F.col(b)).alias(b) for b in ("nir", "red", "swir16", "green")), "scl", "valid")


@query(with_sql(pseudo.SQL, "SELECT k, r, c, " + ", ".join(f"round({nd_sql(n)}, 6) AS {n.lower()}" for n in BANDS_OF) + " FROM px"))
def q_indices(spark, sf_dir):
    return pseudo.pixels(spark, sf_dir).select("k", "r", "c", *(rounded(ix.index(n)).alias(n.lower()) for n in BANDS_OF))


@query(with_sql(pseudo.SQL, f"SELECT k, round(avg((scl NOT IN {SCL_INVALID} AND nir + red + swir16 + green <> 0)::INT), 6) AS valid_fraction, round(avg((scl IN {SCL_DEGRADED})::INT), 6) AS degraded_fraction, count(*) AS n FROM px GROUP BY k"))
def q_scl_masks(spark, sf_dir):
    px = pseudo.pixels(spark, sf_dir)
    good = ix.usable_pixel(("nir", "red", "swir16", "green")).cast("int")
    return px.groupBy("k").agg(rounded(F.avg(good)).alias("valid_fraction"), rounded(F.avg(ix.degraded_class().cast("int"))).alias("degraded_fraction"), F.count("*").alias("n"))


@query(with_sql(pseudo.SQL, """, dn AS (SELECT k, r, c, CASE WHEN k = 2 AND r * 7 + c > 60 THEN 0 ELSE round(swir16 * 10000) + CASE WHEN k = 3 THEN 1000 ELSE 0 END END AS dn FROM px),
p AS (SELECT k, quantile_cont(dn, 0.01::DOUBLE) FILTER (dn > 0) AS p01, count(*) FILTER (dn > 0) AS n FROM dn GROUP BY k),
o AS (SELECT k, CASE WHEN n > 64 THEN p01 ELSE 0 END AS p01 FROM p)
SELECT k, round(any_value(p01), 6) AS p01, any_value(CASE WHEN p01 >= 700 THEN 1000 ELSE 0 END) AS pedestal, round(avg(greatest(0::DOUBLE, least(1.6::DOUBLE, (dn - CASE WHEN p01 >= 700 THEN 1000 ELSE 0 END) * 0.0001::DOUBLE))), 6) AS reflectance FROM dn JOIN o USING (k) GROUP BY k"""))
def q_reflectance_pedestal(spark, sf_dir):
    """One epoch carries the offset, one has too few bright pixels to tell."""
    dn = F.when((F.col("k") == 2) & (F.col("r") * 7 + F.col("c") > 60), 0).otherwise(F.round(F.col("swir16") * 10000) + F.when(F.col("k") == 3, 1000).otherwise(0))
    raw = pseudo.pixels(spark, sf_dir).select("k", dn.alias("swir16"))
    rows = raw.join(ix.pedestals(raw, ["k"]), "k")
    out = rows.groupBy("k").agg(F.first("dark").alias("p01"), F.first("pedestal").alias("pedestal"), F.avg(ix.reflectance(F.col("swir16"), F.col("pedestal"))).alias("reflectance"))
    return out.select("k", rounded("p01").alias("p01"), "pedestal", rounded("reflectance").alias("reflectance"))


@query(with_sql(scored_sql("urban_expansion"), "SELECT r, c FROM core"))
def q_core_valid_erosion(spark, sf_dir):
    return detect.core(detect.pair(pseudo.pixels(spark, sf_dir))).select("r", "c")


@query(with_sql(scored_sql("urban_expansion"), "SELECT r, c, round(delta, 6) AS delta, round(z, 4) AS z FROM sc"))
def q_robust_z(spark, sf_dir):
    return detect.scored(detect.pair(pseudo.pixels(spark, sf_dir)), "urban_expansion").select("r", "c", rounded("delta").alias("delta"), rounded("z", 4).alias("z"))


def _gate_query(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = detect.candidates(pseudo.pixels(spark, sf_dir), mode).where("raw_hit")
        return rows.select("r", "c", "allowed")

    run.__name__ = f"q_gate_{mode}"
    return query(with_sql(scored_sql(mode), "SELECT r, c, allowed FROM cd WHERE raw_hit"))(run)


def _component_query(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        marked = detect.candidates(pseudo.pixels(spark, sf_dir), mode)
        return detect.labelled(marked, pseudo.frame(spark, sf_dir)).select("r", "c", "label")

    run.__name__ = f"q_components_{mode}"
    return query(with_sql(labelled_sql(mode), "SELECT r, c, label FROM lab"))(run)


for _mode in MODES:
    _gate_query(_mode)
for _mode in MODES:
    _component_query(_mode)


@query(with_sql(labelled_sql("urban_expansion"), "SELECT r, c FROM nb"))
def q_neighbour_filter(spark, sf_dir):
    marked = detect.candidates(pseudo.pixels(spark, sf_dir), "urban_expansion")
    return neighbourhood.neighbour_filter(marked.where("raw_hit AND allowed").select(*KEYS)).select("r", "c")


@query(with_sql(scored_sql("urban_expansion"), """, m AS (SELECT r, c FROM core WHERE (r * 7 + c * 13) % 3 <> 0),
off AS (SELECT i.i, j.j FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j)),
dil AS (SELECT DISTINCT r + i AS r, c + j AS c FROM m, off, hh WHERE r + i >= 0 AND c + j >= 0 AND r + i < h AND c + j < h)
SELECT a.r, a.c FROM dil a JOIN dil b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 9"""))
def q_closing(spark, sf_dir):
    frame = pseudo.frame(spark, sf_dir)
    mask = detect.core(detect.pair(pseudo.pixels(spark, sf_dir))).where("(r * 7 + c * 13) % 3 <> 0")
    return neighbourhood.close(mask, frame.height, frame.width).select("r", "c")


@query(with_sql(labelled_sql("urban_expansion"), f"""{CLUSTERS_SQL}
SELECT id, label, n AS pixel_count, round(md, 6) AS mean_delta, round(pd, 6) AS peak_delta, round(ps, 6) AS persistence, round(cr, 6) AS centre_r, round(cc, 6) AS centre_c, r0, r1, c0, c1, onset_year, round(confidence, 6) AS confidence,
  round(ha, 6) AS area_ha, CASE WHEN confidence >= 0.90 THEN 'high' WHEN confidence >= 0.70 THEN 'moderate' ELSE 'low' END AS band, 'New built-up surface' || CASE WHEN ps < 0.4 THEN ' (transient)' ELSE '' END AS name,
  round(cc + 0.5, 6) AS centre_lon, round(-(cr + 0.5), 6) AS centre_lat, round(c0 + 0.5, 6) AS west, round(-(r0 + 0.5), 6) AS north, round(c1 - 0.5, 6) AS east, round(-(r1 - 0.5), 6) AS south FROM t2"""))
def q_cluster_attrs(spark, sf_dir):
    out = detect.clusters(pseudo.pixels(spark, sf_dir), "urban_expansion", pseudo.frame(spark, sf_dir))
    numbers = ("mean_delta", "peak_delta", "persistence", "centre_r", "centre_c", "confidence", "area_ha", "centre_lon", "centre_lat", "west", "south", "east", "north")
    return out.select("id", "label", "name", "band", "pixel_count", "r0", "r1", "c0", "c1", "onset_year", *(rounded(c).alias(c) for c in numbers))


_TIMELINE = f"""{PERSIST_SQL}, hot AS (SELECT base.*, lab.label IS NOT NULL OR (SELECT count(*) FROM lab) = 0 AS hot FROM base LEFT JOIN lab USING (r, c)),
sp AS (SELECT avg(base) AS h0, avg(last) AS h1 FROM hot WHERE hot),
ev AS (SELECT k, year, count(*) FILTER (valid)::DOUBLE / (SELECT h * h FROM hh) AS vf FROM px GROUP BY ALL),
t AS (SELECT v.k, avg(value) AS im, avg(value) FILTER (hot) AS hm, avg((value - base - shift * v.k / k1 >= 0.10::DOUBLE)::INT) AS cf FROM v JOIN hot USING (r, c), ends WHERE valid GROUP BY ALL),
u AS (SELECT ev.*, im, hm, coalesce(cf, 0) AS cf, CASE WHEN abs(h1 - h0) > 1e-6 AND hm IS NOT NULL THEN greatest(0, least(1, (hm - h0) / (h1 - h0))) ELSE 0 END AS p FROM ev LEFT JOIN t USING (k), sp)
SELECT k, year, round(vf, 6) AS valid_fraction, round(im, 6) AS index_mean, round(hm, 6) AS hotspot_mean, round(cf, 6) AS changed_fraction, CASE WHEN k = 0 THEN 'stable' WHEN p >= 0.75 THEN 'changed' WHEN p >= 0.30 THEN 'emerging' ELSE 'stable' END AS status FROM u"""


def _timeline(px: DataFrame, frame) -> DataFrame:
    out = detect.timeline(px, "urban_expansion", frame)
    return out.select("k", "year", "status", *(rounded(c).alias(c) for c in ("valid_fraction", "index_mean", "hotspot_mean", "changed_fraction")))


@query(with_sql(labelled_sql("urban_expansion"), _TIMELINE))
def q_timeline(spark, sf_dir):
    return _timeline(pseudo.pixels(spark, sf_dir), pseudo.frame(spark, sf_dir))


_CLOUDED = pseudo.SQL.replace("px AS (", "px0 AS (") + ", px AS (SELECT * REPLACE (valid AND k <> 4 AND (k <> 2 OR r % 2 = 0) AS valid) FROM px0)"


@query(with_sql(labelled_sql("urban_expansion", _CLOUDED), _TIMELINE))
def q_timeline_clouded(spark, sf_dir):
    """The same with one epoch wholly, one half under cloud: the clouded ones keep their rows."""
    clear = F.col("valid") & (F.col("k") != 4) & ((F.col("k") != 2) | (F.col("r") % 2 == 0))
    return _timeline(pseudo.pixels(spark, sf_dir).withColumn("valid", clear), pseudo.frame(spark, sf_dir))


def _quality(mode: str) -> str:
    return f"""{labelled_sql(mode)}, cv AS (SELECT r, c, count(*) FILTER (valid) < (SELECT count(DISTINCT k) FROM px) AS cloudy FROM px GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM cd) AS core, (SELECT count(*) FROM cd WHERE raw_hit) AS raw_hits, (SELECT count(*) FROM hits) AS gated, (SELECT count(*) FROM lab) AS cleaned, (SELECT h * h FROM hh)::BIGINT AS cells,
  (SELECT count(*) FROM cv WHERE NOT cloudy) AS clear, (SELECT count(*) FROM cv JOIN cd USING (r, c) WHERE cloudy) AS cloudy_core, (SELECT any_value(shift) FROM cd) AS shift, (SELECT any_value(delta / z) FROM cd WHERE z <> 0) AS sigma,
  (SELECT count(*) FROM both_ WHERE {WET_B} AND {nd_sql("NDBI", "_a")} > (-0.08)) AS dried, (SELECT count(*) FROM both_ WHERE {WET_B} <> {WET_A}) AS crossed)"""


def _quality_query(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = detect.quality_counts(pseudo.pixels(spark, sf_dir), mode, pseudo.frame(spark, sf_dir))
        numbers = {"valid_fraction": 6, "noise_rejection": 6, "index_shift": 6, "sigma": 6}
        return out.select("core", "raw_hits", "gate_rejected", "gated", "cleaned", "cloud_masked", "cloud_suppressed", "dried", "crossed", *(rounded(c, d).alias(c) for c, d in numbers.items()))

    run.__name__ = "q_quality_counts" if mode == "vegetation_loss" else f"q_quality_counts_{mode}"
    return query(with_sql(_quality(mode), """SELECT core, raw_hits, raw_hits - gated AS gate_rejected, gated, cleaned, cells - core AS cloud_masked, cells - clear - cloudy_core AS cloud_suppressed, dried, crossed,
  round(core::DOUBLE / cells, 6) AS valid_fraction, round((gated - cleaned)::DOUBLE / nullif(gated, 0), 6) AS noise_rejection, round(shift, 6) AS index_shift, round(sigma, 6) AS sigma FROM n"""))(run)


for _mode in ("vegetation_loss", "urban_expansion", "water_loss"):
    _quality_query(_mode)


_EPOCHS = """, e AS (SELECT k, avg((valid AND r % 3 <= k % 3 AND k <> 2)::INT) AS valid_fraction FROM px GROUP BY k)"""


def _epochs(spark, sf_dir):
    good = F.col("valid") & (F.col("r") % 3 <= F.col("k") % 3) & (F.col("k") != 2)
    return pseudo.pixels(spark, sf_dir).groupBy("aoi", "k").agg(F.avg(good.cast("int")).alias("valid_fraction"))


@query(with_sql(pseudo.SQL + _EPOCHS, "SELECT k, round(valid_fraction, 6) AS valid_fraction FROM e WHERE CASE WHEN (SELECT count(*) FROM e WHERE valid_fraction >= 0.25) >= 2 THEN valid_fraction >= 0.25 ELSE k IN (SELECT k FROM e ORDER BY valid_fraction DESC, k LIMIT 2) END"))
def q_usable_epochs(spark, sf_dir):
    return detect.usable_epochs(_epochs(spark, sf_dir)).select("k", rounded("valid_fraction").alias("valid_fraction"))


@query(with_sql(pseudo.SQL, "SELECT DISTINCT k FROM px WHERE k < 3 OR k = (SELECT max(k) FROM px)"))
def q_epoch_cap(spark, sf_dir):
    return detect.cap_epochs(pseudo.pixels(spark, sf_dir).select("aoi", "k").distinct(), 4).select("k")


@query(with_sql(pseudo.SQL, """, src AS (SELECT k, r, c, ord, CASE WHEN (r + c + ord) % 3 = 0 THEN 0 ELSE nir + ord END AS nir, CASE WHEN (r + c + ord) % 3 = 0 THEN 0 ELSE swir16 + ord END AS swir16 FROM px, (VALUES (0), (1), (2)) t(ord))
SELECT k, r, c, round(coalesce(arg_min(nir, ord) FILTER (swir16 > 0), arg_min(nir, ord)), 6) AS nir, round(coalesce(arg_min(swir16, ord) FILTER (swir16 > 0), arg_min(swir16, ord)), 6) AS swir16 FROM src GROUP BY k, r, c"""))
def q_mosaic_fill(spark, sf_dir):
    px = pseudo.pixels(spark, sf_dir).withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    gap = (F.col("r") + F.col("c") + F.col("ord")) % 3 == 0
    rows = px.select("aoi", "k", "r", "c", "ord", *(F.when(gap, 0.0).otherwise(F.col(b) + F.col("ord")).alias(b) for b in ("nir", "swir16")))
    return detect.mosaic(rows, ("nir", "swir16")).select("k", "r", "c", rounded("nir").alias("nir"), rounded("swir16").alias("swir16"))


@query(with_sql(pseudo.SQL, """, q AS (SELECT k, quantile_cont(red, 0.02::DOUBLE) AS lo, quantile_cont(red, 0.96::DOUBLE) AS hi FROM px WHERE valid GROUP BY k)
SELECT k, r, c, CASE WHEN valid THEN floor(255 * pow(greatest(0::DOUBLE, least(1::DOUBLE, (red - lo) / greatest(hi - lo, 1e-6::DOUBLE))), 1 / 1.05::DOUBLE) + 1e-9)::INT ELSE 28 END AS shade FROM px JOIN q USING (k)"""))
def q_percentile_stretch(spark, sf_dir):
    return raster.stretched(pseudo.pixels(spark, sf_dir), ("red",), ("k",)).select("k", "r", "c", F.col("red").alias("shade"))


_TAU = "(2 * pi())"


@query(with_sql(scored_sql("urban_expansion"), f""", im AS (SELECT r, c, {nd_sql("NDBI", "_b")} AS a, {nd_sql("NDBI", "_a")} AS b FROM cd),
n AS (SELECT h::DOUBLE AS n, (SELECT sum(a) FROM im) / (h * h) AS ma, (SELECT sum(b) FROM im) / (h * h) AS mb FROM hh),
ax AS (SELECT i::INT AS i FROM hh, range(h) t(i)),
im2 AS (SELECT y.i AS r, x.i AS c, (coalesce(a, 0) - ma) * (0.5::DOUBLE - 0.5::DOUBLE * cos({_TAU} * y.i / (n - 1))) * (0.5::DOUBLE - 0.5::DOUBLE * cos({_TAU} * x.i / (n - 1))) AS a, (coalesce(b, 0) - mb) * (0.5::DOUBLE - 0.5::DOUBLE * cos({_TAU} * y.i / (n - 1))) * (0.5::DOUBLE - 0.5::DOUBLE * cos({_TAU} * x.i / (n - 1))) AS b FROM ax y CROSS JOIN ax x CROSS JOIN n LEFT JOIN im ON im.r = y.i AND im.c = x.i),
f1 AS (SELECT r, v.i AS v, sum(a * cos({_TAU} * v.i * c / n)) AS ar, -sum(a * sin({_TAU} * v.i * c / n)) AS ai, sum(b * cos({_TAU} * v.i * c / n)) AS br, -sum(b * sin({_TAU} * v.i * c / n)) AS bi FROM im2, ax v, n GROUP BY ALL),
f2 AS (SELECT u.i AS u, v, sum(ar * cos({_TAU} * u.i * r / n) + ai * sin({_TAU} * u.i * r / n)) AS ar, sum(ai * cos({_TAU} * u.i * r / n) - ar * sin({_TAU} * u.i * r / n)) AS ai, sum(br * cos({_TAU} * u.i * r / n) + bi * sin({_TAU} * u.i * r / n)) AS br, sum(bi * cos({_TAU} * u.i * r / n) - br * sin({_TAU} * u.i * r / n)) AS bi FROM f1, ax u, n GROUP BY ALL),
cr AS (SELECT u, v, (ar * br + ai * bi) / greatest(m, 1e-12::DOUBLE) AS x, (ai * br - ar * bi) / greatest(m, 1e-12::DOUBLE) AS y FROM (SELECT *, sqrt(pow(ar * br + ai * bi, 2) + pow(ai * br - ar * bi, 2)) AS m FROM f2)),
i1 AS (SELECT u, c.i AS c, sum(x * cos({_TAU} * v * c.i / n) - y * sin({_TAU} * v * c.i / n)) AS x, sum(x * sin({_TAU} * v * c.i / n) + y * cos({_TAU} * v * c.i / n)) AS y FROM cr, ax c, n GROUP BY ALL),
i2 AS (SELECT r.i AS r, c, sum(x * cos({_TAU} * u * r.i / n) - y * sin({_TAU} * u * r.i / n)) / any_value(n * n) AS p FROM i1, ax r, n GROUP BY ALL),
pk AS (SELECT arg_max(r, p) AS r, arg_max(c, p) AS c, max(p) / (stddev_pop(p) + 1e-12::DOUBLE) AS sharp FROM i2)
SELECT round(sqrt(pow(CASE WHEN r > h // 2 THEN r - h ELSE r END, 2) + pow(CASE WHEN c > h // 2 THEN c - h ELSE c END, 2)), 6) AS shift_px, round(sharp, 3) AS sharpness FROM pk, hh"""))
def q_phase_shift(spark, sf_dir):
    """The registration shift of an analysis; its twin sums the transform term by term."""
    marked = detect.candidates(pseudo.pixels(spark, sf_dir), "urban_expansion")
    return detect.registration(marked, "urban_expansion", pseudo.frame(spark, sf_dir)).select(rounded("shift_px").alias("shift_px"), rounded("sharpness", 3).alias("sharpness"))


@query(with_sql(scored_sql("urban_expansion"), f"""{PERSIST_SQL} SELECT base.r, base.c, round(coalesce(p, 0), 6) AS persistence FROM base LEFT JOIN pe USING (r, c)"""))
def q_persistence(spark, sf_dir):
    px = detect.kept(pseudo.pixels(spark, sf_dir))
    return detect.persistence(px, detect.candidates(px, "urban_expansion"), "urban_expansion").select("r", "c", rounded("persistence").alias("persistence"))


_SIGNATURE = f"""SELECT unnest([round(vb, 6), round(va, 6), round(va - vb, 6), round(bb, 6), round(ba, 6), round(ba - bb, 6), round(wb, 6), round(wa, 6), round(wa - wb, 6), round(ch / n, 6), round(least(1, ncl / (n * 0.01::DOUBLE / 100) / 10), 6),
  round(CASE WHEN ch > 0 THEN least(1, ncl / ch * 50) ELSE 0 END, 6), round(CASE WHEN ncl > 0 THEN least(1, ch * 0.01::DOUBLE / ncl / 50) ELSE 0 END, 6)]) AS value, unnest(range(13))::INT AS dim
FROM (SELECT count(*)::DOUBLE AS n, {", ".join(f"avg(({nd_sql(i, e)} > {t}::DOUBLE)::INT) AS {x}{e[1]}" for x, i, t in (("v", "NDVI", 0.30), ("b", "NDBI", 0.0), ("w", "MNDWI", 0.05)) for e in ("_b", "_a"))} FROM both_ WHERE valid),
(SELECT count(*)::DOUBLE AS ch, least(count(DISTINCT label), 40)::DOUBLE AS ncl FROM lab)"""


@query(with_sql(labelled_sql("urban_expansion"), _SIGNATURE))
def q_signature(spark, sf_dir):
    px, frame = detect.kept(pseudo.pixels(spark, sf_dir)), pseudo.frame(spark, sf_dir)
    labels = detect.labelled(detect.candidates(px, "urban_expansion"), frame)
    rows = signatures.describe(detect.pair(px), labels, frame.pixel_ha)
    return rows.select(F.posexplode("vector").alias("dim", "x")).select("dim", rounded("x").alias("value"))


@query(with_sql(pseudo.SQL, """, t AS (SELECT k, h, (h * 3) // 2 AS m, tr::INT AS tr, tc::INT AS tc FROM (SELECT DISTINCT k FROM px), hh, range((h * 3) // 2) a(tr), range((h * 3) // 2) b(tc))
SELECT t.k, tr AS r, tc AS c, round(coalesce(nir, 0), 6) AS nir, coalesce(scl, 0) AS scl FROM t LEFT JOIN px ON px.k = t.k AND px.r = floor((tr + 0.5::DOUBLE) * h / m) AND px.c = floor((tc + 0.5::DOUBLE) * h / m)"""))
def q_resample_nearest(spark, sf_dir):
    h = pseudo.side(spark, sf_dir)
    out = raster.resample_nearest(pseudo.pixels(spark, sf_dir), ["nir", "scl"], ["k"], (h, h), (h * 3 // 2, h * 3 // 2))
    return out.select("k", "r", "c", rounded(F.coalesce("nir", F.lit(0.0))).alias("nir"), F.coalesce("scl", F.lit(0)).alias("scl"))


@query(with_sql(pseudo.SQL, """, t AS (SELECT k, tr::INT AS tr, tc::INT AS tc, (tr + 0.5::DOUBLE) * h / ((h * 2) // 3) - 0.5::DOUBLE AS y, (tc + 0.5::DOUBLE) * h / ((h * 2) // 3) - 0.5::DOUBLE AS x FROM (SELECT DISTINCT k FROM px), hh, range((h * 2) // 3) a(tr), range((h * 2) // 3) b(tc)),
w AS (SELECT t.*, px.nir, px.red, (1 - abs(y - px.r)) * (1 - abs(x - px.c)) AS w FROM t LEFT JOIN px ON px.k = t.k AND abs(y - px.r) < 1 AND abs(x - px.c) < 1)
SELECT k, tr AS r, tc AS c, round(sum(w * nir) / sum(w), 10) AS nir, round(sum(w * red) / sum(w), 10) AS red FROM w GROUP BY ALL"""))
def q_resample_bilinear(spark, sf_dir):
    h = pseudo.side(spark, sf_dir)
    out = raster.resample_bilinear(pseudo.pixels(spark, sf_dir), ["nir", "red"], ["k"], (h, h), (h * 2 // 3, h * 2 // 3))
    return out.select("k", "r", "c", rounded("nir", 10).alias("nir"), rounded("red", 10).alias("red"))


@query("""WITH s AS (SELECT p_partkey, p_size * 137.0::DOUBLE AS w, p_retailprice * 3::DOUBLE AS h, CASE p_partkey % 3 WHEN 0 THEN [1, 2, 4, 8, 16] WHEN 1 THEN [1, 3, 9] ELSE [1] END AS levels FROM part),
b AS (SELECT *, least(w / 480, h / 320) / 4 AS need, sqrt(w * h / 1e6::DOUBLE / 6) AS cap FROM s)
SELECT p_partkey, greatest(coalesce(list_max(list_filter(levels, lambda x: x <= need)), 1), CASE WHEN cap > 1 THEN coalesce(list_min(list_filter(levels, lambda x: x >= cap)), list_max(levels)) ELSE 1 END)::INT AS level FROM b""")
def q_overview_level(spark, sf_dir):
    ladder = lambda *xs: F.array(*(F.lit(x) for x in xs))
    levels = F.when(F.col("p_partkey") % 3 == 0, ladder(1, 2, 4, 8, 16)).when(F.col("p_partkey") % 3 == 1, ladder(1, 3, 9)).otherwise(ladder(1))
    level = raster.overview_level(F.col("p_size") * 137.0, F.col("p_retailprice") * 3, F.lit(480), F.lit(320), levels)
    return pseudo.table(spark, sf_dir, "part").select("p_partkey", level.alias("level"))


# ---- scenes ----------------------------------------------------------------------------------------------------------------------------------

_ANCHOR = f"""{pseudo.SCENES_SQL},
an AS (SELECT a, year, min(cloud) AS cloud FROM s, range(15, 366, 10) t(a) WHERE least(abs(doy - a) % 365, 365 - abs(doy - a) % 365) <= 45 GROUP BY ALL),
ag AS (SELECT a, count(*) AS covered, list_sort(list(cloud))[count(*) // 2 + 1] AS med FROM an GROUP BY a),
anchor AS (SELECT a::INT AS anchor, covered, med FROM ag ORDER BY covered DESC, med, a LIMIT 1)"""


@query(with_sql(_ANCHOR, "SELECT anchor, covered, round(med, 6) AS med FROM anchor"))
def q_season_anchor(spark, sf_dir):
    return scenes.season_anchor(pseudo.scenes(spark, sf_dir)).select("anchor", "covered", rounded("med").alias("med"))


@query(with_sql(pseudo.SCENES_SQL, "SELECT mgrs, count(*) AS n, count(DISTINCT year) AS years FROM s GROUP BY mgrs"))
def q_tile_coverage(spark, sf_dir):
    return scenes.tile_coverage(pseudo.scenes(spark, sf_dir))


_BEST = f"""{_ANCHOR}, tile AS (SELECT mgrs FROM (SELECT mgrs, count(*) AS n, count(DISTINCT year) AS y FROM s GROUP BY mgrs ORDER BY y DESC, n DESC, mgrs LIMIT 1) WHERE y >= (SELECT count(DISTINCT year) FROM s)),
d AS (SELECT s.*, least(abs(doy - anchor) % 365, 365 - abs(doy - anchor) % 365) AS days FROM s, anchor),
f AS (SELECT *, (days > 45)::INT AS tier, (mgrs IN (SELECT mgrs FROM tile))::INT AS own FROM d WHERE days <= 90),
b AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY tier, own DESC, round_even(cloud, 1), days, id) AS nth FROM f)"""


@query(with_sql(_BEST, "SELECT year, id, date, mgrs, round(cloud, 6) AS cloud, tier = 1 AS relaxed FROM b WHERE nth = 1"))
def q_best_scene_per_year(spark, sf_dir):
    return scenes.best_per_year(pseudo.scenes(spark, sf_dir)).select("year", "id", "date", "mgrs", rounded("cloud").alias("cloud"), "relaxed")


@query(with_sql(_BEST, """, p AS (SELECT b.id AS chosen_id, s.id AS companion_id, s.mgrs, s.cloud, row_number() OVER (PARTITION BY b.id, s.mgrs ORDER BY s.cloud, s.id) AS j FROM b JOIN s ON s.date = b.date AND s.mgrs <> b.mgrs AND s.id <> b.id WHERE nth = 1)
SELECT chosen_id, companion_id, mgrs, row_number() OVER (PARTITION BY chosen_id ORDER BY cloud, companion_id)::INT AS ord FROM p WHERE j = 1"""))
def q_companions(spark, sf_dir):
    s = pseudo.scenes(spark, sf_dir)
    return scenes.companions(s, scenes.best_per_year(s))


@query("""SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS date, CASE WHEN o_custkey % 4 = 0 THEN 100 ELSE o_totalprice END AS cloud, 'T' || (o_custkey % 5) AS mgrs FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def q_scene_projection(spark, sf_dir):
    o = pseudo.table(spark, sf_dir, "orders")
    href = lambda b: F.format_string('"%s":{"href":"%s"}', F.lit(b), F.when((F.lit(b) == "nir") & (F.col("o_orderkey") % 7 == 0), "").otherwise("x"))
    cloud = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit('"eo:cloud_cover":'), F.col("o_totalprice").cast("string"), F.lit(",")))
    date = F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    which = F.when(F.col("o_custkey") % 2 == 0, "grid:code").otherwise("s2:mgrs_tile")
    feature = F.concat(F.lit('{"id":"'), F.col("o_orderkey").cast("string"), F.lit('","properties":{'), cloud, F.lit('"'), which, F.lit('":"T'), (F.col("o_custkey") % 5).cast("string"), F.lit('","datetime":"'), date, F.lit('"},"assets":{'), F.concat_ws(",", *(href(b) for b in scenes.REQUIRED)), F.lit("}}"))
    return scenes.project(o.select(feature.alias("feature"))).select("id", "date", "cloud", "mgrs")


# ---- places ----------------------------------------------------------------------------------------------------------------------------------

_G_SQL = "g(ord, k, label) AS (VALUES " + ", ".join(f"({i}, '{x[0]}', '{x[1]}')" for i, x in enumerate(GAZETTEER)) + ")"
_NAMES = "CASE n_nationkey % 5 WHEN 0 THEN upper(k) WHEN 1 THEN k || ', hyderabad' WHEN 2 THEN 'old ' || k || ' lake' WHEN 3 THEN substr(k, 1, 4) ELSE lower(n_name) END"


@query(f"""WITH {_G_SQL}, p AS (SELECT {_NAMES} AS query FROM nation JOIN g ON ord = n_nationkey),
h AS (SELECT query, k, label, ord, CASE WHEN k = lower(trim(query)) THEN 0 WHEN query LIKE '%,%' AND k = trim(split_part(lower(trim(query)), ',', 1)) THEN 1 WHEN contains(lower(trim(query)), k) OR contains(k, lower(trim(query))) THEN 2 END AS tier FROM (SELECT DISTINCT query FROM p), g),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, ord) AS nth FROM h WHERE tier IS NOT NULL)
SELECT query, b.k AS key, label FROM (SELECT DISTINCT query FROM p) LEFT JOIN (SELECT * FROM b WHERE nth = 1) b USING (query)""")
def q_gazetteer_lookup(spark, sf_dir):
    g = places.gazetteer(spark).select("ord", F.col("key").alias("k"))
    names = pseudo.table(spark, sf_dir, "nation").join(F.broadcast(g), F.col("ord") == F.col("n_nationkey"))
    return places.look_up(names.select(F.expr(_NAMES).alias("query")))


_BOX = "(c_custkey * 37 % 720) - 360.0::DOUBLE AS w, (c_acctbal / 50)::DOUBLE AS s, (c_custkey * 37 % 720) - 360.0::DOUBLE + (c_custkey % 7) * 0.1::DOUBLE AS e, (c_acctbal / 50)::DOUBLE + (c_nationkey % 5 - 2) * 0.2::DOUBLE AS n"


def _boxes(spark, sf_dir):
    w = (F.col("c_custkey") * 37 % 720) - 360.0
    s = F.col("c_acctbal") / 50
    return pseudo.table(spark, sf_dir, "customer").select("c_custkey", w.alias("w"), s.alias("s"), (w + (F.col("c_custkey") % 7) * 0.1).alias("e"), (s + (F.col("c_nationkey") % 5 - 2) * 0.2).alias("n"))


_CLAMP = f"""a AS (SELECT c_custkey, {_BOX} FROM customer),
b AS (SELECT c_custkey, CASE WHEN x THEN s ELSE w END AS w, CASE WHEN x THEN w ELSE s END AS s, CASE WHEN x THEN n ELSE e END AS e, CASE WHEN x THEN e ELSE n END AS n FROM (SELECT *, (abs(w) > 180 OR abs(e) > 180) AND abs(s) <= 180 AND abs(n) <= 180 AS x FROM a)),
c AS (SELECT c_custkey, greatest(-180, least(180, least(w, e))) AS w, greatest(-180, least(180, greatest(w, e))) AS e, greatest(-85, least(85, least(s, n))) AS s, greatest(-85, least(85, greatest(s, n))) AS n FROM b),
d AS (SELECT c_custkey, (w + e) / 2 AS x, (s + n) / 2 AS y, greatest(0.012::DOUBLE, least(0.5::DOUBLE, e - w)) / 2 AS dx, greatest(0.012::DOUBLE, least(0.5::DOUBLE, n - s)) / 2 AS dy FROM c),
z AS (SELECT c_custkey, round(x - dx, 6) AS w, round(y - dy, 6) AS s, round(x + dx, 6) AS e, round(y + dy, 6) AS n FROM d)"""


@query(f"WITH {_CLAMP} SELECT c_custkey, round(w, 5) AS w, round(s, 5) AS s, round(e, 5) AS e, round(n, 5) AS n FROM z")
def q_bbox_clamp(spark, sf_dir):
    out = _boxes(spark, sf_dir).select("c_custkey", places.clamp_box(*(F.col(c) for c in "wsen")).alias("b"))
    return out.select("c_custkey", *(rounded(f"b.{c}", 5).alias(c) for c in "wsen"))


@query(f"""WITH {_CLAMP}, y AS (SELECT *, abs(e - w) AS dx, abs(n - s) AS dy FROM z),
x AS (SELECT *, CASE WHEN dx >= dy THEN 480 ELSE greatest(64, round_even(480 * dx / dy, 0)::INT) END AS width, CASE WHEN dx >= dy THEN greatest(64, round_even(480 * dy / dx, 0)::INT) ELSE 480 END AS height, radians((s + n) / 2) AS m FROM y)
SELECT c_custkey, width, height, round(dy / height * (111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * m) + 1.175::DOUBLE * cos(4 * m)) * (dx / width * abs(111412.84::DOUBLE * cos(m) - 93.5::DOUBLE * cos(3 * m))) / 10000, 8) AS pixel_ha FROM x""")
def q_grid_pixel_area(spark, sf_dir):
    box = _boxes(spark, sf_dir).select("c_custkey", places.clamp_box(*(F.col(c) for c in "wsen")).alias("b")).select("c_custkey", "b.*")
    sides = [F.col(c) for c in "wsen"]
    out = box.withColumn("size", places.grid_size(*sides))
    return out.select("c_custkey", "size.width", "size.height", rounded(places.pixel_ha(*sides, F.col("size.width"), F.col("size.height")), 8).alias("pixel_ha"))


_RING = ((10.0, -10.0), (80.0, 0.0), (60.0, 60.0), (30.0, 20.0), (-40.0, 70.0), (-70.0, -20.0))
_EDGES = [(*_RING[i], *_RING[(i + 1) % len(_RING)]) for i in range(len(_RING))]


@query(f"""WITH e(x0, y0, x1, y1) AS (VALUES {", ".join("(" + ", ".join(f"({v})::DOUBLE" for v in x) + ")" for x in _EDGES)}),
p AS (SELECT c_custkey AS pid, (c_custkey * 37 % 180) - 90.0::DOUBLE AS lon, c_acctbal / 100 AS lat FROM customer),
h AS (SELECT pid, count(*) AS n FROM p JOIN e ON (y0 > lat) <> (y1 > lat) AND lon < x0 + (lat - y0) / coalesce(nullif(y1 - y0, 0), 1e-12::DOUBLE) * (x1 - x0) GROUP BY pid)
SELECT pid, coalesce(n, 0) % 2 = 1 AS inside FROM p LEFT JOIN h USING (pid)""")
def q_point_in_polygon(spark, sf_dir):
    points = pseudo.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), ((F.col("c_custkey") * 37 % 180) - 90.0).alias("lon"), (F.col("c_acctbal") / 100).alias("lat"))
    edges = spark.createDataFrame(_EDGES, "x0 double, y0 double, x1 double, y1 double")
    return places.inside_rings(points, edges).select("pid", "inside")


# ---- study windows and reports -----------------------------------------------------------------------------------------------------------------

_REGION = ("Ringland", -70.0, -20.0, 80.0, 70.0)
_CELLS = "SELECT i::INT AS i, (-70.0)::DOUBLE + 150.0::DOUBLE * (i % 9 + 0.5::DOUBLE) / 9 AS lon, (-20.0)::DOUBLE + 90.0::DOUBLE * (i // 9 + 0.5::DOUBLE) / 7 AS lat FROM range(63) t(i)"
_EDGE_SQL = "e(x0, y0, x1, y1) AS (VALUES " + ", ".join("(" + ", ".join(f"({v})::DOUBLE" for v in x) + ")" for x in _EDGES) + ")"


def _parity(points: str) -> str:
    return f"SELECT p.*, (SELECT count(*) FROM e WHERE (y0 > p.y) <> (y1 > p.y) AND p.x < x0 + (p.y - y0) / coalesce(nullif(y1 - y0, 0), 1e-12::DOUBLE) * (x1 - x0)) % 2 = 1 AS inside FROM {points} p"


@query(f"""WITH {_EDGE_SQL}, cells AS ({_CELLS}), h AS (SELECT (c_custkey % 63)::INT AS i, avg(c_acctbal) / 100 AS elevation FROM customer WHERE c_custkey % 63 <> 5 GROUP BY ALL),
pts AS (SELECT i, lon AS x, lat AS y FROM cells), c AS (SELECT q.i, q.x, q.y, elevation FROM ({_parity("pts")}) q JOIN h USING (i) WHERE inside),
best AS (SELECT x AS bx, y AS by_, elevation FROM c ORDER BY (elevation >= 5) DESC, elevation, i LIMIT 1),
held AS (SELECT greatest(-69.75::DOUBLE, least(79.75::DOUBLE, bx)) AS bx, greatest(-19.75::DOUBLE, least(69.75::DOUBLE, by_)) AS by_, elevation FROM best),
mv AS (SELECT 0 AS o, 0::DOUBLE AS dx, 0::DOUBLE AS dy UNION ALL SELECT 1 + si * 8 + mi, mx * 0.5::DOUBLE * st, my * 0.5::DOUBLE * st FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 0.75::DOUBLE), (3, 1::DOUBLE)) s(si, st), (VALUES {", ".join(f"({i}, ({a}), ({b}))" for i, (a, b) in enumerate(MOVES))}) m(mi, mx, my)),
tr AS (SELECT o, bx + dx AS cx, by_ + dy AS cy, elevation FROM held, mv WHERE o = 0 OR (bx + dx BETWEEN (-69.75)::DOUBLE AND 79.75::DOUBLE AND by_ + dy BETWEEN (-19.75)::DOUBLE AND 69.75::DOUBLE)),
pr AS (SELECT tr.*, cx + a.v * 0.25::DOUBLE AS x, cy + b.v * 0.25::DOUBLE AS y FROM tr, (VALUES (-0.9::DOUBLE), (-0.45::DOUBLE), (0::DOUBLE), (0.45::DOUBLE), (0.9::DOUBLE)) a(v), (VALUES (-0.9::DOUBLE), (-0.45::DOUBLE), (0::DOUBLE), (0.45::DOUBLE), (0.9::DOUBLE)) b(v)),
sh AS (SELECT o, cx, cy, elevation, avg(inside::INT) AS coverage FROM ({_parity("pr")}) GROUP BY ALL ORDER BY coverage DESC, o LIMIT 1)
SELECT '{_REGION[0]}' AS name, round(cx, 6) AS lon, round(cy, 6) AS lat, round(elevation, 6) AS elevation, round(coverage, 6) AS coverage FROM sh""")
def q_study_window(spark, sf_dir):
    """The window of a region whose scan cells get their heights from the customers' balances; one cell has none."""
    cells = spark.range(63).select(F.col("id").cast("int").alias("i"), (-70.0 + 150.0 * (F.col("id") % 9 + 0.5) / 9).alias("lon"), (-20.0 + 90.0 * (F.floor(F.col("id") / 9) + 0.5) / 7).alias("lat"))
    heights = pseudo.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 63).cast("int").alias("i")).agg((F.avg("c_acctbal") / 100).alias("elevation")).where("i <> 5")
    regions = spark.createDataFrame([_REGION], "name string, w double, s double, e double, n double")
    edges = spark.createDataFrame([(_REGION[0], *x) for x in _EDGES], "name string, x0 double, y0 double, x1 double, y1 double")
    out = study.study_windows(regions, edges, cells.join(heights, "i").select("lon", "lat", "elevation"))
    return out.select("name", *(rounded(c).alias(c) for c in ("lon", "lat", "elevation", "coverage")))


@query("""WITH a AS (SELECT p_partkey, sqrt(p_partkey + 0.5::DOUBLE) * p_size * p_size / 100 AS ha FROM part)
SELECT p_partkey, CASE WHEN ha >= 100 THEN format('{:.2f}', ha / 100) || ' km² (' || format('{:,}', round_even(ha, 0)::BIGINT) || ' ha)' WHEN ha >= 1 THEN format('{:,.1f}', ha) || ' ha' ELSE format('{:,}', round_even(ha * 10000, 0)::BIGINT) || ' m²' END AS area FROM a""")
def q_area_format(spark, sf_dir):
    ha = F.sqrt(F.col("p_partkey") + 0.5) * F.col("p_size") * F.col("p_size") / 100
    return pseudo.table(spark, sf_dir, "part").select("p_partkey", ix.area_text(ha).alias("area"))


@query("""SELECT c_nationkey AS aoi, CASE WHEN count(*) > 1 THEN CASE WHEN sum(lat * ha) / sum(ha) > (min(lat) + max(lat)) / 2 THEN 'northern' ELSE 'southern' END || ' and ' || CASE WHEN sum(lon * ha) / sum(ha) > (min(lon) + max(lon)) / 2 THEN 'eastern' ELSE 'western' END END AS bias
FROM (SELECT c_nationkey, (c_custkey * 37 % 180) - 90.0::DOUBLE AS lon, (c_custkey * 53 % 97)::DOUBLE AS lat, abs(c_acctbal) + 1 AS ha FROM customer) GROUP BY c_nationkey""")
def q_spatial_bias(spark, sf_dir):
    rows = pseudo.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("aoi"), ((F.col("c_custkey") * 37 % 180) - 90.0).alias("lon"), (F.col("c_custkey") * 53 % 97).cast("double").alias("lat"), (F.abs("c_acctbal") + 1).alias("area_ha"))
    return report.spatial_bias(rows)


@query("""SELECT p_partkey, round(greatest(0.05::DOUBLE, least(0.97::DOUBLE, CASE WHEN cl > 0 THEN x ELSE least(x, 0.72::DOUBLE) END)), 6) AS confidence FROM (SELECT p_partkey, cl, 0.50::DOUBLE + 0.15::DOUBLE * least(vf / 0.9::DOUBLE, 1) + 0.12::DOUBLE * CASE WHEN n >= 4 THEN 1 WHEN n = 3 THEN 0.6::DOUBLE ELSE 0 END
  + CASE WHEN cl > 0 THEN 0.13::DOUBLE * least(p / 0.6::DOUBLE, 1) ELSE 0 END + 0.10::DOUBLE - CASE WHEN cloud > 10 THEN 0.08::DOUBLE ELSE 0 END AS x FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS vf, p_partkey % 7 AS n, p_partkey % 4 AS cl, p_partkey % 11 / 11.0::DOUBLE AS p, p_retailprice % 20 AS cloud FROM part))""")
def q_overall_confidence(spark, sf_dir):
    k = F.col("p_partkey")
    rows = pseudo.table(spark, sf_dir, "part").select(k, (F.col("p_size") / 50).alias("valid_fraction"), (k % 7).alias("epoch_count"), (k % 4).alias("cluster_count"), (k % 11 / 11).alias("mean_persistence"), (F.col("p_retailprice") % 20).alias("mean_cloud"))
    return rows.select("p_partkey", rounded(report.overall_confidence()).alias("confidence"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 9 <> 0""")
def q_frames_round_trip(spark, sf_dir):
    """Events as JSON lines, every ninth one cut short, read back: broken lines are skipped, numbers that JSON can't hold are null."""
    e = pseudo.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    text = files.frames(e).withColumn("id", F.get_json_object("value", "$.event_id").cast("long"))
    cut = text.select(F.when(F.col("id") % 9 == 0, F.substring("value", 1, 9)).otherwise(F.col("value")).alias("value"))
    return files.parse_frames(cut, "event_id long, value double")


# ---- signatures, events, display ---------------------------------------------------------------------------------------------------------------

_W_SQL = "[" + ", ".join(f"{w}::DOUBLE" for w in SIGNATURE_WEIGHTS) + "]"


def _signatures(spark, sf_dir):
    e = pseudo.table(spark, sf_dir, "embeddings")
    return e.select(F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("key"), F.col("vec_id").alias("seq"), F.slice("embedding", 1, 13).cast("array<double>").alias("vector"))


@query(f"""WITH v AS (SELECT lpad(vec_id::VARCHAR, 6, '0') AS key, embedding[1:13]::DOUBLE[] AS v, vec_id FROM embeddings),
d AS (SELECT q.key AS query_key, p.key, sqrt(list_sum(list_transform(range(1, 14), lambda i: pow((q.v[i] - p.v[i]) * {_W_SQL}[i], 2)))) AS distance FROM v q JOIN v p ON q.key <> p.key WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(distance, 9), key) AS rank FROM d)
SELECT query_key, key, rank::INT AS rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM r WHERE rank <= 4""")
def q_similarity_topk(spark, sf_dir):
    s = _signatures(spark, sf_dir)
    out = signatures.most_similar(s.where("seq % 20 = 0"), s)
    return out.select("query_key", "key", "rank", rounded("distance").alias("distance"), rounded("similarity").alias("similarity"))


@query("""WITH o AS (SELECT lpad(vec_id::VARCHAR, 6, '0') AS key, vec_id AS seq FROM embeddings), n AS (SELECT lpad(vec_id::VARCHAR, 6, '0') AS key, vec_id + 1000000 AS seq FROM embeddings WHERE label = 0)
SELECT key, seq FROM (SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n) ORDER BY seq DESC, key LIMIT 200""")
def q_signature_upsert(spark, sf_dir):
    """All signatures as the store; those of one class are analysed again."""
    store = _signatures(spark, sf_dir)
    again = pseudo.table(spark, sf_dir, "embeddings").where("label = 0").select(F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("key"))
    new = store.join(again, "key", "left_semi").withColumn("seq", F.col("seq") + 1000000)
    return signatures.upsert(store, new).select("key", "seq")


@query("SELECT event_type || '-' || user_id % 10 AS step, arg_max(event_id, event_id) AS value FROM events GROUP BY ALL")
def q_ndjson_fold(spark, sf_dir):
    e = pseudo.table(spark, sf_dir, "events")
    rows = e.select(F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")).alias("step"), F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    return fold_events(rows)


@query("SELECT least(a, 365 - a)::BIGINT AS days, count(*) AS n FROM (SELECT abs(dayofyear(l_shipdate) - 200) % 365 AS a FROM lineitem) GROUP BY ALL")
def q_circular_days(spark, sf_dir):
    rows = pseudo.table(spark, sf_dir, "lineitem").select(ix.circular_days(F.dayofyear("l_shipdate"), F.lit(200)).cast("long").alias("days"))
    return rows.groupBy("days").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN c >= 0.90 THEN 'high' WHEN c >= 0.70 THEN 'moderate' ELSE 'low' END AS band FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS c FROM part)")
def q_confidence_band(spark, sf_dir):
    return pseudo.table(spark, sf_dir, "part").select("p_partkey", ix.confidence_band(F.col("p_size") / 50.0).alias("band"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question, read as a plan, answered by the clusters of its mode."""
    question = spark.createDataFrame([("Show me where urban expansion occurred between 2016 and 2022",)], "text string")
    plan = interpret.interpret(question, TODAY).first()
    px = pseudo.pixels(spark, sf_dir).where(F.col("year").between(plan["start_year"], plan["end_year"]))
    return detect.clusters(px, plan["mode"], pseudo.frame(spark, sf_dir)).orderBy("id")


from . import analysis, imagery, questions, selection  # noqa: E402, F401  (they register their queries)
