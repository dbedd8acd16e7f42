"""Queries on whole analyses: measures, sentences, reports, signatures, stage events and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import engine as engines
from ..constants import ARCHETYPES, INDEX_META, NAMED_DIMENSIONS, SIGNATURE_NAMES, SIGNATURE_WEIGHTS
from ..engine import Engine, Request
from ..operators import detect, report, signatures
from ..scratch import scratch_path
from ..streaming.epochs import windowed_counts
from . import pseudo
from .registry import CLUSTERS_SQL, TODAY, WET_A, WET_B, labelled_sql, nd_sql, query, rounded, with_sql

MODE, SHIFT = "urban_expansion", 2.5

# ---- measures -----------------------------------------------------------------------------------------------------------------------------------

#: After `labelled_sql(MODE)`: st, one row of measures, for an analysis whose images are SHIFT pixels out of line and clouded by twice the number of their date, in percent.
_STATS = f"""{CLUSTERS_SQL}, cvq AS (SELECT r, c, count(*) FILTER (valid) < (SELECT count(DISTINCT k) FROM px) AS cloudy FROM px GROUP BY ALL),
t3 AS (SELECT * REPLACE (greatest(0.05::DOUBLE, least(0.98::DOUBLE, 0.50::DOUBLE + 0.20::DOUBLE * least(abs(md) / 0.30::DOUBLE, 1) + 0.18::DOUBLE * ps + 0.08::DOUBLE * least(n / 400.0::DOUBLE, 1) - 0.10::DOUBLE - CASE WHEN cl > 0.10 THEN 0.12::DOUBLE * cl ELSE 0 END)) AS confidence) FROM t2),
nq AS (SELECT (SELECT count(*) FROM cd) AS core, (SELECT count(*) FROM cd WHERE raw_hit) AS raw_hits, (SELECT count(*) FROM hits) AS gated, (SELECT count(*) FROM lab) AS cleaned, (SELECT h * h FROM hh)::BIGINT AS cells,
  (SELECT count(*) FROM cvq WHERE NOT cloudy) AS clear, (SELECT count(*) FROM cvq JOIN cd USING (r, c) WHERE cloudy) AS cloudy_core, (SELECT any_value(shift) FROM cd) AS drift,
  (SELECT count(*) FROM both_ WHERE {WET_B} AND {nd_sql("NDBI", "_a")} > (-0.08)) AS dried, (SELECT min(k) FROM px) AS ka, (SELECT max(k) FROM px) AS kz, (SELECT count(DISTINCT k) FROM px) AS epochs, (SELECT min(year) FROM px) AS y0, (SELECT max(year) FROM px) AS y1, (SELECT avg(2.0::DOUBLE * k) FROM (SELECT DISTINCT k FROM px)) AS cloud),
cq AS (SELECT coalesce(sum(n), 0) AS px, coalesce(sum(ha), 0) AS ha, coalesce(max(ha), 0) AS largest, count(*) AS clusters, count(*) FILTER (id <= 40) AS detailed, coalesce(avg(ps) FILTER (id <= 40), 0) AS pers, count(*) FILTER (id <= 40 AND confidence < 0.7) AS low FROM t3),
s0 AS (SELECT *, core::DOUBLE / cells AS vf, 100.0::DOUBLE * px / greatest(core, 1) AS pct, core * 0.01::DOUBLE AS analysed, raw_hits - gated AS refused, cells - clear - cloudy_core AS suppressed FROM nq, cq),
s1 AS (SELECT *, 0.50::DOUBLE + 0.15::DOUBLE * least(vf / 0.9::DOUBLE, 1) + 0.12::DOUBLE * CASE WHEN epochs >= 4 THEN 1 WHEN epochs = 3 THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN clusters > 0 THEN 0.13::DOUBLE * least(pers / 0.6::DOUBLE, 1) ELSE 0 END - CASE WHEN cloud > 10 THEN 0.08::DOUBLE ELSE 0 END AS raw FROM s0),
st AS (SELECT *, greatest(0.05::DOUBLE, least(0.97::DOUBLE, CASE WHEN clusters > 0 THEN raw ELSE least(raw, 0.72::DOUBLE) END)) AS conf FROM s1),
sb AS (SELECT *, CASE WHEN conf >= 0.90 THEN 'high' WHEN conf >= 0.70 THEN 'moderate' ELSE 'low' END AS band FROM st)"""


def _measured(spark, sf_dir) -> dict[str, DataFrame]:
    """Clusters, epochs, shift, quality and measures of the pseudo-raster's city, with invented cloud and shift."""
    px, frame = detect.kept(pseudo.pixels(spark, sf_dir)), pseudo.frame(spark, sf_dir)
    marked = detect.kept(detect.candidates(px, MODE))
    labels = detect.kept(detect.labelled(marked, frame))
    shift = spark.createDataFrame([(1, SHIFT)], "aoi long, shift_px double")
    clusters = detect.kept(detect.clusters(px, MODE, frame, shift_px=shift, scored_by=(marked, labels)))
    date = F.make_date("year", F.lit(5), F.lit(1))
    epochs = px.groupBy("aoi", "k", "year").agg((F.count_if("valid") / frame.pixels).alias("valid_fraction")).withColumns({"date": date, "cloud": 2.0 * F.col("k"), "scene_id": F.format_string("S%d", "year")})
    epochs = detect.kept(epochs)
    quality = detect.quality_counts(px, MODE, frame, scored_by=(marked, labels))
    stats = detect.kept(report.stats(clusters, quality, epochs, frame.pixel_ha, shift))
    return {"clusters": clusters, "epochs": epochs, "shift": shift, "stats": stats, "labels": labels}


@query(with_sql(labelled_sql(MODE), f"""{_STATS} SELECT px::BIGINT AS changed_pixels, round(ha, 6) AS changed_area_ha, round(ha / 100, 8) AS changed_area_km2, round(analysed, 6) AS analysed_area_ha, round(pct, 6) AS changed_percent, 0.01::DOUBLE AS pixel_area_ha, 10.0::DOUBLE AS pixel_size_m, clusters AS cluster_count, detailed AS clusters_detailed,
  round(largest, 6) AS largest_cluster_ha, round(pers, 6) AS mean_persistence, low AS low_confidence, y0 AS baseline_year, y1 AS latest_year, make_date(y0, 5, 1) AS baseline_date, make_date(y1, 5, 1) AS latest_date, epochs AS epoch_count, round(cloud, 6) AS mean_cloud, round(vf, 6) AS valid_fraction, round(conf, 6) AS confidence, band FROM sb"""))
def q_stats(spark, sf_dir):
    """All measures of an analysis, its confidence lowered by scenes out of line and under cloud."""
    out = _measured(spark, sf_dir)["stats"]
    whole = ("changed_pixels", "cluster_count", "clusters_detailed", "low_confidence", "baseline_year", "latest_year", "baseline_date", "latest_date", "epoch_count", "band", "pixel_area_ha", "pixel_size_m")
    numbers = {"changed_area_ha": 6, "changed_area_km2": 8, "analysed_area_ha": 6, "changed_percent": 6, "largest_cluster_ha": 6, "mean_persistence": 6, "mean_cloud": 6, "valid_fraction": 6, "confidence": 6}
    return out.select(*whole, *(rounded(c, d).alias(c) for c, d in numbers.items()))


@query("""WITH t AS (SELECT c_nationkey AS aoi, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 2015 + c_custkey % 9 END AS y FROM customer) SELECT aoi, min(y) AS first_onset, max(y) AS last_onset, count(DISTINCT y) AS onsets FROM t GROUP BY aoi HAVING count(y) > 0""")
def q_onset_span(spark, sf_dir):
    rows = pseudo.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("aoi"), F.when(F.col("c_custkey") % 6 != 0, 2015 + F.col("c_custkey") % 9).alias("onset_year"))
    return report.onset_span(rows).where("onsets > 0")


@query("""WITH c AS (SELECT c_nationkey AS aoi, c_custkey AS label, 6 + (c_custkey * 7) % 30 AS n FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY n DESC, label) AS id FROM c)
SELECT aoi, id::INT AS id, label, n AS pixel_count FROM r WHERE id <= 20""")
def q_top_clusters(spark, sf_dir):
    """The largest components of many areas, ties by label: lines of pixels, one component a customer."""
    c = pseudo.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("aoi"), F.col("c_custkey").cast("int").alias("i"), (6 + (F.col("c_custkey") * 7) % 30).cast("int").alias("n"))
    px = c.select("aoi", F.col("i").alias("label"), (F.col("i") * 2).alias("r"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    sizes = px.groupBy("aoi", "label").agg(F.count("*").alias("pixel_count"))
    return detect.ranked(sizes).where(F.col("id") <= report.RESPONSE_CLUSTERS).select("aoi", "id", "label", "pixel_count")


# ---- sentences ----------------------------------------------------------------------------------------------------------------------------------

def _pct(x: str) -> str:
    return f"(floor({x} * 100 + 0.5::DOUBLE)::BIGINT || ' %')"


def _n(x: str) -> str:
    return f"format('{{:,}}', ({x})::BIGINT)"


@query(with_sql(labelled_sql(MODE), f"""{_STATS} SELECT id, concat_ws(' ', 'NDBI moved by ' || printf('%+.3f', md) || ' on average.', CASE WHEN ps >= 0.6 THEN 'The change shows in ' || {_pct('ps')} || ' of the later dates.' END, CASE WHEN ha >= 1 THEN 'It covers ' || printf('%.1f', ha) || ' ha in one piece.' END) AS evidence,
  concat_ws(' ', CASE WHEN ps < 0.6 THEN 'The change shows in only ' || {_pct('ps')} || ' of the later dates and may pass.' END, 'The images are out of line, which can widen edges.', CASE WHEN cl > 0.10 THEN {_pct('cl')} || ' of it was clouded on some date.' END) AS caveats, round(confidence, 6) AS confidence FROM t3"""))
def q_cluster_findings(spark, sf_dir):
    got = _measured(spark, sf_dir)
    rows = report.cluster_findings(got["clusters"], MODE, 7, got["shift"])
    return rows.select("id", F.concat_ws(" ", "evidence").alias("evidence"), F.concat_ws(" ", "caveats").alias("caveats"), rounded("confidence").alias("confidence"))


_EVIDENCE = (
    f"CASE WHEN vf >= 0.55 THEN {_pct('vf')} || ' of the area is clear in both ' || y0 || ' and ' || y1 || '.' END",
    "CASE WHEN abs(drift) >= 0.02 THEN 'NDBI moved by ' || printf('%+.3f', drift) || ' in the whole scene; such an even change comes from light, air or season and was taken out.' ELSE 'NDBI moved by only ' || printf('%+.3f', drift) || ' in the whole scene, so the dates compare well.' END",
    f"CASE WHEN refused > 0 THEN {_n('refused')} || ' pixels (' || {_pct('refused::DOUBLE / greatest(raw_hits, 1)')} || ' of the hits) were refused because their surface does not fit the change asked for.' END",
    f"CASE WHEN dried > 0 THEN {_n('dried')} || ' pixels look built because water left them; dry lake bed is no construction and was left out.' END",
    "'Only pixels that look built in the last image count.'",
    f"CASE WHEN gated > 0 AND gated > cleaned THEN {_n('gated - cleaned')} || ' of ' || {_n('gated')} || ' hits (' || {_pct('(gated - cleaned)::DOUBLE / gated')} || ') were single pixels or patches too small to map.' END",
    f"CASE WHEN suppressed > 0 THEN {_n('suppressed')} || ' pixels were left out because a date shows cloud, shadow or snow there.' END",
    "CASE WHEN epochs >= 3 THEN epochs || ' dates from ' || y0 || ' to ' || y1 || ' let every hit be tested for persistence.' END",
    "CASE WHEN clusters > 0 THEN clusters || ' clusters passed every test: ' || printf('%.1f', ha) || ' ha, ' || printf('%.2f', pct) || ' % of the analysed area.' END",
)
_CAVEATS = (
    f"CASE WHEN vf < 0.55 THEN 'Only ' || {_pct('vf')} || ' of the area is clear in both end images; the rest could not be judged.' END",
    f"'The images are about {SHIFT:.1f} pixels out of line, which can feign change along edges.'",
    "CASE WHEN epochs < 3 THEN 'Only two dates were usable, so a passing state of the ground cannot be ruled out.' END",
    "CASE WHEN cloud > 10 THEN 'The scenes are clouded by ' || floor(cloud + 0.5::DOUBLE)::BIGINT || ' % on average.' END",
    "CASE WHEN clusters = 0 THEN 'No cluster passed the tests of strength, persistence and size; by this measure the area is stable.' END",
)


@query(with_sql(labelled_sql(MODE), f"{_STATS} SELECT concat_ws(' ', {', '.join(_EVIDENCE)}) AS evidence, concat_ws(' ', {', '.join(_CAVEATS)}) AS caveats FROM sb"))
def q_findings(spark, sf_dir):
    """What speaks for an analysis and what limits it."""
    out = report.findings(_measured(spark, sf_dir)["stats"], MODE)
    return out.select(F.concat_ws(" ", "evidence").alias("evidence"), F.concat_ws(" ", "caveats").alias("caveats"))


def _area(x: str) -> str:
    return f"CASE WHEN {x} >= 100 THEN printf('%.2f', {x} / 100) || ' km² (' || format('{{:,}}', round_even({x}, 0)::BIGINT) || ' ha)' WHEN {x} >= 1 THEN printf('%.1f', {x}) || ' ha' ELSE format('{{:,}}', round_even({x} * 10000, 0)::BIGINT) || ' m²' END"


_CALLED, _WHY, _WHOM, _ADVICE = report.CONTEXT[MODE]
_NAME, _FORMULA, _ = INDEX_META["NDBI"]
_YEARS = "'between ' || y0 || ' and ' || y1"
_HEAD = f"CASE WHEN clusters > 0 THEN {_area('ha')} || ' of {_CALLED} in Ringland ' || {_YEARS} || ', in ' || clusters || CASE WHEN clusters = 1 THEN ' cluster.' ELSE ' clusters.' END ELSE 'No {_CALLED} of note in Ringland ' || {_YEARS} || '.' END"
_SUMMARY = (
    "epochs || ' images of Ringland from ' || y0 || '-05-01 to ' || y1 || '-05-01, all of one season, were compared.'",
    f"'Change is that of NDBI, {_FORMULA}, on pixels of about 10 m.'",
    f"CASE WHEN clusters > 0 THEN {_area('ha')} || ', ' || printf('%.2f', pct) || ' % of the ' || {_area('analysed')} || ' that could be judged, passed every test; the largest cluster has ' || {_area('largest')} || '.' ELSE 'Of the ' || {_area('analysed')} || ' that could be judged, no patch was both strong and large enough to report.' END",
    "CASE WHEN clusters > 0 AND bias IS NOT NULL THEN 'Most of it lies in the ' || bias || ' part.' END",
    "CASE WHEN clusters > 0 AND onsets = 1 THEN 'It began in ' || o0 || '.' WHEN clusters > 0 AND onsets > 1 THEN 'It began between ' || o0 || ' and ' || o1 || ', step by step.' END",
)
_SURE = (
    "'Confidence is ' || band || ' (' || round_even(conf * 100, 0)::BIGINT || ' %).'",
    f"CASE WHEN vf >= 0.85 THEN {_pct('vf')} || ' of the area is clear on both end dates.' ELSE 'Only ' || {_pct('vf')} || ' of the area is clear on both end dates, which lowers it.' END",
    "CASE WHEN epochs >= 3 THEN epochs || ' dates allow a test of persistence.' ELSE 'Two dates allow no test of persistence.' END",
    f"'The images are {SHIFT:.1f} pixels out of line.'",
    f"CASE WHEN pers > 0 THEN 'Changes show in ' || {_pct('pers')} || ' of the later dates on average.' END",
    "CASE WHEN band = 'low' THEN 'Take it as a hint that needs a check, not as a finding.' END",
)
_SO = f"CASE WHEN clusters > 0 THEN '{_WHY} It concerns {_WHOM}. {report.NEARBY['water']} Next: {_ADVICE}' ELSE 'A stable result gives Ringland a dated baseline for later looks. It concerns {_WHOM}.' END"
_STEPS = (
    f"CASE WHEN clusters > 0 THEN '{_ADVICE}' ELSE 'Nothing needs doing for this measure; a longer period may show more.' END",
    "CASE WHEN clusters > 0 THEN 'Visit the largest and surest clusters first.' END",
    "CASE WHEN clusters > 0 AND band <> 'high' THEN 'Look again over a wider period or in the season beside this one.' END",
    "CASE WHEN clusters > 0 AND low > 0 THEN low || ' clusters have a confidence below 70 %: confirm them before use.' END",
    f"'{report.CLOSING}'",
)
_STORY = f"""{_STATS}, bs AS (SELECT CASE WHEN count(*) > 1 THEN CASE WHEN sum(-(cr + 0.5::DOUBLE) * ha) / sum(ha) > (min(-(cr + 0.5::DOUBLE)) + max(-(cr + 0.5::DOUBLE))) / 2 THEN 'northern' ELSE 'southern' END || ' and ' || CASE WHEN sum((cc + 0.5::DOUBLE) * ha) / sum(ha) > (min(cc + 0.5::DOUBLE) + max(cc + 0.5::DOUBLE)) / 2 THEN 'eastern' ELSE 'western' END END AS bias,
  min(onset_year) AS o0, max(onset_year) AS o1, count(DISTINCT onset_year) AS onsets FROM t3 WHERE id <= 40),
sy AS (SELECT *, {_HEAD} AS head FROM sb, bs)"""


def _story(spark, sf_dir) -> dict[str, DataFrame]:
    got = _measured(spark, sf_dir)
    detailed = got["clusters"].where("id <= 40")
    bias = report.spatial_bias(detailed.select("aoi", F.col("centre_lon").alias("lon"), F.col("centre_lat").alias("lat"), "area_ha"))
    found = report.findings(got["stats"], MODE)
    return got | {"story": report.narrative(got["stats"], bias, report.onset_span(detailed), found, MODE, "Ringland", "water")}


@query(with_sql(labelled_sql(MODE), f"{_STORY} SELECT head AS headline, concat_ws(' ', {', '.join(_SUMMARY)}) AS summary, concat_ws(' ', {', '.join(_SURE)}) AS confidence_text, {_SO} AS so_what, concat_ws(' ', {', '.join(_STEPS)}) AS recommendations, 'Built-up Expansion: Ringland' AS title, y0 || '–' || y1 AS period, coalesce(bias, CASE WHEN clusters = 1 THEN 'single cluster' ELSE 'not applicable' END) AS concentration, round_even(conf * 100, 0)::INT AS confidence_percent, 'NDBI, {_NAME}' AS indicator FROM sy"))
def q_narrative(spark, sf_dir):
    """Headline, summary, confidence, meaning, next steps and the fields of the report."""
    out = _story(spark, sf_dir)["story"]
    return out.select("headline", "summary", "confidence_text", "so_what", F.concat_ws(" ", "recommendations").alias("recommendations"), *(F.col(f"report.{c}").alias(c) for c in ("title", "period", "concentration", "confidence_percent", "indicator")))


_LINE = "chr(10) || chr(10)"
_REPORT = f"""{_STORY}, ls AS (SELECT string_agg('| ' || id || ' | New built-up surface' || CASE WHEN ps < 0.4 THEN ' (transient)' ELSE '' END || ' | ' || format('{{:,.2f}}', ha) || ' | ' || printf('%.4f', -(cr + 0.5::DOUBLE)) || ', ' || printf('%.4f', cc + 0.5::DOUBLE) || ' | ' || printf('%+.3f', md) || ' | ' || {_pct('ps')} || ' | ' || coalesce(onset_year::VARCHAR, '-') || ' | ' || {_pct('confidence')} || ' |', chr(10) ORDER BY id) AS listed FROM t3 WHERE id <= 15),
ix AS (SELECT string_agg('| ' || year || '-05-01 | S' || year || ' | ' || printf('%.1f', 2.0::DOUBLE * k) || ' % | ' || {_pct('f')} || ' |', chr(10) ORDER BY k) AS images FROM (SELECT k, year, count(*) FILTER (valid)::DOUBLE / (SELECT h * h FROM hh) AS f FROM px GROUP BY ALL)),
rp AS (SELECT concat_ws({_LINE}, '# Built-up Expansion: Ringland', 'Question: Why?  ' || chr(10) || 'Place: Ringland  ' || chr(10) || 'Period: ' || y0 || '–' || y1 || ' (' || y0 || '-05-01 to ' || y1 || '-05-01)  ' || chr(10) || 'Measure: NDBI, {_NAME}  ' || chr(10) || 'Data: Sentinel-2 surface reflectance',
  '## Headline', '> ' || head, 'Confidence: ' || round_even(conf * 100, 0)::BIGINT || ' % (' || upper(band) || ')', '## Summary', concat_ws(' ', {', '.join(_SUMMARY)}), concat_ws(' ', {', '.join(_SURE)}),
  '## Measures', '| Measure | Value |' || chr(10) || '|-|-|' || chr(10) || concat_ws(chr(10), '| Changed ground | ' || CASE WHEN clusters > 0 THEN {_area('ha')} ELSE 'none to report' END || ' |', '| Share of the analysed area | ' || printf('%.2f', pct) || ' % |', '| Analysed ground | ' || format('{{:,}}', round_even(analysed, 0)::BIGINT) || ' ha |', '| Clusters | ' || clusters || ' |',
    '| Largest cluster | ' || format('{{:,.1f}}', largest) || ' ha |', '| Pixel | about 10 m |', '| Images | ' || epochs || ' |', '| Mean persistence | ' || {_pct('pers')} || ' |'),
  '## Images', '| Date | Scene | Cloud | Usable pixels |' || chr(10) || '|-|-|-|-|' || chr(10) || images, '## Evidence', array_to_string(list_transform(list_filter([{', '.join(_EVIDENCE)}], lambda x: x IS NOT NULL), lambda x: '- ' || x), chr(10)),
  '## Limits' || {_LINE} || array_to_string(list_transform(list_filter([{', '.join(_CAVEATS)}], lambda x: x IS NOT NULL), lambda x: '- ' || x), chr(10)), '## Meaning', {_SO}, '## Next', array_to_string(list_transform(list_filter([{', '.join(_STEPS)}], lambda x: x IS NOT NULL), lambda x: '- ' || x), chr(10)),
  CASE WHEN listed IS NOT NULL THEN '## Clusters (' || least(clusters, 15) || ' of ' || clusters || ')' || {_LINE} || '| # | Change | Hectares | Centre | Mean delta | Persistence | Onset | Confidence |' || chr(10) || '|-|-|-|-|-|-|-|-|' || chr(10) || listed END,
  '---', 'Confidence is the strength of what the images show, not a legal status; confirm before acting.') AS report FROM sy, ls, ix)"""


@query(with_sql(labelled_sql(MODE), f"{_REPORT} SELECT unnest(string_split(report, chr(10))) AS line, generate_subscripts(string_split(report, chr(10)), 1)::INT AS nr FROM rp"))
def q_report(spark, sf_dir):
    """The Markdown report, line by line."""
    got = _story(spark, sf_dir)
    text = report.markdown("Why?", detect.kept(got["story"]), got["stats"], got["clusters"], got["epochs"])
    return text.select(F.posexplode(F.split("report", "\n")).alias("nr", "line")).select((F.col("nr") + 1).alias("nr"), "line")


# ---- signatures ---------------------------------------------------------------------------------------------------------------------------------


def _records(spark, sf_dir) -> DataFrame:
    """`embeddings` as signature records; every ninth vector is too short."""
    e, i = pseudo.table(spark, sf_dir, "embeddings"), F.col("vec_id")
    vector = F.when(i % 9 == 0, F.slice("embedding", 1, 5)).otherwise(F.slice("embedding", 1, 13)).cast("array<double>")
    return e.select(F.format_string("a-%06d", "vec_id").alias("key"), i.alias("seq"), F.format_string("Area %d", i).alias("label"), (i % 90).cast("double").alias("lon"), (i % 45).cast("double").alias("lat"), F.lit("2016-2022").alias("period"), F.lit("water_loss").alias("mode"), vector.alias("vector"), F.lit("-").alias("headline"), (i / 4).alias("area_ha"))


_AT = [SIGNATURE_NAMES.index(n) for n in NAMED_DIMENSIONS]
_GAPS = "[" + ", ".join(f"{{'gap': abs(a[{i + 1}] - b[{i + 1}]) * {SIGNATURE_WEIGHTS[i]}::DOUBLE, 'i': {i}, 's': '{t} (' || printf('%+.2f', a[{i + 1}]) || ' vs ' || printf('%+.2f', b[{i + 1}]) || ')'}}" for i, t in zip(_AT, NAMED_DIMENSIONS.values(), strict=True)) + "]"
_WHY_SQL = f"'Closest agreement on ' || array_to_string(list_transform(list_sort({_GAPS})[1:2], lambda g: g.s), ' and ') || '.'"


@query(f"WITH v AS (SELECT vec_id, embedding[1:13]::DOUBLE[] AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM v x JOIN v y ON y.vec_id = x.vec_id + 1) SELECT vec_id, {_WHY_SQL} AS why FROM p")
def q_match_explanation(spark, sf_dir):
    """Why each vector is like its successor."""
    v = pseudo.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 13).cast("array<double>").alias("a"))
    rows = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return rows.select("vec_id", signatures.explain(F.col("a"), F.col("b")).alias("why"))


_QUERY = ARCHETYPES[2][-1]
_ARCHE = ", ".join(f"('{k}', {i - len(ARCHETYPES)}, '{label}', '{m}', [{', '.join(f'{x}::DOUBLE' for x in v)}])" for i, (k, label, _, _, m, v) in enumerate(ARCHETYPES))


@query(f"""WITH q AS (SELECT [{', '.join(f'{x}::DOUBLE' for x in _QUERY)}] AS a), p(key, seq, label, mode, b) AS (SELECT * FROM (VALUES {_ARCHE}) UNION ALL SELECT printf('a-%06d', vec_id), vec_id, 'Area ' || vec_id, 'water_loss', embedding[1:13]::DOUBLE[] FROM embeddings WHERE vec_id % 9 <> 0),
d AS (SELECT *, sqrt(list_sum(list_transform(range(1, 14), lambda i: pow((a[i] - b[i]) * [{', '.join(f'{w}::DOUBLE' for w in SIGNATURE_WEIGHTS)}][i], 2)))) AS d FROM p, q)
SELECT key, label, mode, round_even(1 / (1 + d), 4) AS similarity, round_even(100 / (1 + d), 0)::INT AS similarity_percent, round_even(d, 4) AS distance, {_WHY_SQL} AS why, key LIKE 'ref-%' AS is_reference FROM d ORDER BY similarity DESC, seq LIMIT 9""")
def q_matches(spark, sf_dir):
    """The records most like one area, from those that come with the package and a store; vectors of another length take no part."""
    pool = signatures.archetypes(spark).unionByName(_records(spark, sf_dir))
    out = signatures.matches(F.array(*(F.lit(x) for x in _QUERY)), pool, 9)
    return out.select("key", "label", "mode", "similarity", "similarity_percent", "distance", "why", "is_reference")


# ---- engine -------------------------------------------------------------------------------------------------------------------------------------

_RUNS = [(s, x) for s in engines.STEPS[:-1] for x in ("running", "done")] + [("complete", "done")]
QUESTION = "Show urban expansion in Ringland between 2016 and 2022"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{x}')" for i, (s, x) in enumerate(_RUNS)) + ") t(nr, step, status)")
def q_stage_events(spark, sf_dir):
    """The events of a whole analysis, in order."""
    events = list(Engine(spark, pseudo.archive(spark, sf_dir), today=TODAY).analyze(QUESTION, grid=64))
    return spark.createDataFrame([(i, e["step"], e["status"]) for i, e in enumerate(events)], "nr int, step string, status string")


#: (case, what is asked, the step that ends it): every one is an error event, and the last.
_BAD = (
    ("no place", Request("Show me water expansion"), "locate"),
    ("unknown place", Request("Show water expansion in Zzzqqxx Nowhereland between 2021 and 2025"), "locate"),
    ("box without a number", Request(QUESTION, bbox=(1.0, 2.0, float("nan"), 4.0)), "locate"),
    ("no images in the years", Request(QUESTION, start=2024, end=2026), "search"),
    ("no images in the box", Request(QUESTION, bbox=(40.0, 40.0, 40.2, 40.2)), "search"),
    ("one date alone", Request(QUESTION, start=2021, end=2022, max_cloud=3.0), "search"),
    ("catalog out of reach", Request(QUESTION), "search"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}', 'error')" for c, _, s in _BAD) + ") t(\"case\", step, status)")
def q_stage_errors(spark, sf_dir):
    """Requests that cannot be answered end with an error event at the step that finds it out."""
    archive, rows = pseudo.archive(spark, sf_dir), []
    for case, ask, _ in _BAD:
        source = scratch_path(spark, "nothing") if case == "catalog out of reach" else archive
        last = list(Engine(spark, source, today=TODAY).analyze(ask))[-1]
        rows.append((case, last["step"], last["status"]))
    return spark.createDataFrame(rows, "case string, step string, status string")


@query()
def q_report_lines(spark, sf_dir):
    """The Markdown report of a question over the whole pseudo-raster, read from its raw images."""
    engine = Engine(spark, pseudo.archive(spark, sf_dir), today=TODAY)
    for _ in engine.analyze(QUESTION, grid=max(64, pseudo.side(spark, sf_dir))):
        pass
    return engine.report()


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in engines.EXAMPLES) + ") t(title, query, icon, note)")
def q_examples(spark, sf_dir):
    return engines.examples(spark)


@query("""WITH e AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n, round(total, 4) AS total FROM e WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_windows(spark, sf_dir):
    """`events` as a stream of three files: daily counts, each told once the watermark has passed its day."""
    e = pseudo.table(spark, sf_dir, "events").select("ts", "event_type", "value")
    low, high = e.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), F.array(F.lit(0.33), F.lit(0.66))).alias("q")).first()["q"]
    folder, out, state = (scratch_path(spark, x) for x in ("events", "windows", "state"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for part in (at < low, (at >= low) & (at < high), at >= high):
        e.where(part).coalesce(1).write.mode("append").parquet(folder)
    windows = windowed_counts(spark, folder, e.schema).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
    windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(out).select("day", "event_type", "n", rounded("total", 4).alias("total"))
