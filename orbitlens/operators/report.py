"""Words for results: where change lies, evidence and caveats, headline, summary, recommendations and the Markdown report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INDEX_META, MODES, SETTINGS, Settings
from ..functions.indices import area_text, confidence_band, mode_index, shown
from .detect import with_shift
from .interpret import sanitise

#: Clusters that a response and a report list.
RESPONSE_CLUSTERS, REPORT_CLUSTERS = 20, 15
LOW, CLOUDY, DRIFTED = 0.70, 10.0, 0.10

#: mode: (what it is called in a sentence, why it matters, whom it concerns, what to do next)
CONTEXT = {
    "urban_expansion": ("built-up expansion", "New built surfaces seal soil, raise run-off and press on water bodies and farmland nearby.", "town planners and builders of drains and roads", "Compare the sites with permits and land-use plans."),
    "vegetation_loss": ("vegetation loss", "Lost plant cover exposes soil, reduces shade and habitat, and can precede a change of land use.", "forest and environment offices", "Check the sites on the ground or with finer images before the next season."),
    "vegetation_gain": ("vegetation gain", "New plant cover can be recovery, planting or a crop cycle; only later seasons tell them apart.", "planting and farming programmes", "Look again after a full season to rule out a crop cycle."),
    "water_loss": ("shrinking water", "A smaller water surface reduces storage; a dry year, abstraction and infilling look alike from above.", "water and irrigation offices", "Set the change against rainfall and reservoir records."),
    "water_gain": ("water expansion", "A larger water surface can be a flood, a filled reservoir or a wet season.", "flood response and irrigation offices", "Set the change against rainfall and river levels of the date."),
    "burn_scar": ("burned ground", "Burned ground loses plant cover at once and may erode before it recovers.", "fire services and forest offices", "Confirm with fire records and watch the slopes for erosion."),
}
NEARBY = {
    "water": "The question is about ground near water: look first at changes beside lakes, tanks and rivers, where building is often restricted.",
    "forest": "The question is about ground near forest: set the sites against the recorded forest boundary.",
    "urban": "The question is about ground near a town: set the sites against its plan.",
    "farmland": "The question is about farmland: rule out crop cycles before anything else.",
}
CLOSING = "Satellite pixels of ten to twenty metres show where to look; they replace neither a visit nor a survey."


def _percent(x: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f %%", x * 100)


def _sentences(*parts: Column) -> Column:
    """The sentences that apply, in order: null ones are left out."""
    return F.array_compact(F.array(*(p.cast("string") for p in parts)))


# ---- measures -----------------------------------------------------------------------------------------------------------------------------------


def spatial_bias(clusters: DataFrame) -> DataFrame:
    """(aoi, bias): the side of the area on which changed ground lies (`clusters`: aoi, lon, lat, area_ha); null with one cluster.

    The area-weighted mean of the centres is set against the middle of their range.
    """
    total = F.sum("area_ha")
    weight = lambda c: F.when(total > 0, F.sum(F.col(c) * F.col("area_ha")) / total).otherwise(0.0)
    middle = lambda c: (F.min(c) + F.max(c)) / 2
    ns = F.when(weight("lat") > middle("lat"), "northern").otherwise("southern")
    ew = F.when(weight("lon") > middle("lon"), "eastern").otherwise("western")
    return clusters.groupBy("aoi").agg(F.when(F.count("*") > 1, F.concat_ws(" and ", ns, ew)).alias("bias"))


def onset_span(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("aoi").agg(F.min("onset_year").alias("first_onset"), F.max("onset_year").alias("last_onset"), F.count_distinct("onset_year").alias("onsets"))


def stats(clusters: DataFrame, quality: DataFrame, epochs: DataFrame, pixel_ha: float, shift_px: float | DataFrame = 0.0, settings: Settings = SETTINGS) -> DataFrame:
    """One row an AOI of `quality`: changed and analysed ground, clusters, largest, mean persistence of the detailed clusters, epochs, and the confidence of the whole.

    `clusters` as detect.clusters returns them, `quality` as detect.quality_counts, `epochs` (aoi, k, year, date, cloud in percent), `shift_px` as for detect.clusters.
    """
    found = clusters.groupBy("aoi").agg(
        F.sum("pixel_count").alias("changed_pixels"),
        F.sum("area_ha").alias("changed_area_ha"),
        F.max("area_ha").alias("largest_cluster_ha"),
        F.count("*").alias("cluster_count"),
        F.count_if(F.col("id") <= settings.detail_cap).alias("clusters_detailed"),
        F.avg(F.when(F.col("id") <= settings.detail_cap, F.col("persistence"))).alias("mean_persistence"),
        F.count_if((F.col("id") <= settings.detail_cap) & (F.col("confidence") < LOW)).alias("low_confidence"),
    )
    ends = {f"{end}_{what}": pick(what, "k") for end, pick in (("baseline", F.min_by), ("latest", F.max_by)) for what in ("year", "date")}
    seen = epochs.groupBy("aoi").agg(F.count("*").alias("epoch_count"), F.avg("cloud").alias("mean_cloud"), *(c.alias(n) for n, c in ends.items()))
    rows = quality.join(seen, "aoi").join(found, "aoi", "left")
    rows = rows.fillna(0, ["changed_pixels", "changed_area_ha", "largest_cluster_ha", "cluster_count", "clusters_detailed", "mean_persistence", "low_confidence"])
    rows = with_shift(rows, shift_px).withColumns({
        "changed_area_km2": F.col("changed_area_ha") / 100, "analysed_area_ha": F.col("core") * pixel_ha, "changed_percent": 100 * F.col("changed_pixels") / F.greatest("core", F.lit(1)),
        "pixel_area_ha": F.lit(pixel_ha), "pixel_size_m": F.sqrt(F.lit(pixel_ha * 10000)),
    })
    rows = rows.withColumn("confidence", overall_confidence(F.col("shift_px"), settings))
    return rows.withColumn("band", confidence_band(F.col("confidence")))


#: Digits with which results show their numbers.
DIGITS = {
    "changed_area_ha": 2, "changed_area_km2": 3, "analysed_area_ha": 2, "changed_percent": 3, "pixel_area_ha": 5, "pixel_size_m": 1, "largest_cluster_ha": 2, "mean_persistence": 3, "confidence": 3,
    "valid_fraction": 3, "degraded_fraction": 3, "shift_px": 2, "sharpness": 1, "index_shift": 4, "sigma": 4, "noise_rejection": 3, "cloud": 2, "area_ha": 3, "mean_delta": 4, "peak_delta": 4,
    "persistence": 3, "centre_lon": 6, "centre_lat": 6, "west": 6, "south": 6, "east": 6, "north": 6, "index_mean": 4, "hotspot_mean": 4, "changed_fraction": 4,
}


def display(rows: DataFrame) -> DataFrame:
    """The rows with every number that has a place in DIGITS rounded half to even, as responses show it; numbers that JSON can't hold are null."""
    return rows.withColumns({c: shown(F.col(c), DIGITS[c]) for c in rows.columns if c in DIGITS})


def overall_confidence(shift_px: float | Column = 0.0, settings: Settings = SETTINGS) -> Column:
    """From valid_fraction, epoch_count, cluster_count, mean_persistence and mean_cloud: more clear ground, more epochs and lasting clusters raise it; nothing found holds it down."""
    n, some = F.col("epoch_count"), F.col("cluster_count") > 0
    raw = (
        F.lit(0.50)
        + 0.15 * F.least(F.col("valid_fraction") / 0.9, F.lit(1.0))
        + 0.12 * F.when(n >= 4, 1.0).when(n == 3, 0.6).otherwise(0.0)
        + F.when(some, 0.13 * F.least(F.coalesce("mean_persistence", F.lit(0.0)) / settings.persistence_share, F.lit(1.0))).otherwise(0.0)
        + F.when(F.lit(shift_px) <= settings.max_shift, 0.10).otherwise(0.0)
        - F.when(F.col("mean_cloud") > CLOUDY, 0.08).otherwise(0.0)
    )
    return F.greatest(F.lit(0.05), F.least(F.lit(0.97), F.when(some, raw).otherwise(F.least(raw, F.lit(0.72)))))


# ---- evidence and caveats -------------------------------------------------------------------------------------------------------------------------


def cluster_findings(clusters: DataFrame, mode: str, epochs: int | Column, shift_px: float | DataFrame = 0.0, settings: Settings = SETTINGS) -> DataFrame:
    """The clusters of detect.clusters with `evidence` and `caveats`: arrays of sentences on strength, persistence, size, alignment and cloud."""
    lasting, several = F.col("persistence"), F.lit(epochs) >= 3
    evidence = _sentences(
        F.format_string(f"{mode_index(mode)} moved by %+.3f on average.", "mean_delta"),
        F.when(several & (lasting >= settings.persistence_share), F.concat(F.lit("The change shows in "), _percent(lasting), F.lit(" of the later dates."))),
        F.when(F.col("area_ha") >= 1.0, F.format_string("It covers %.1f ha in one piece.", "area_ha")),
    )
    caveats = _sentences(
        F.when(several & (lasting < settings.persistence_share), F.concat(F.lit("The change shows in only "), _percent(lasting), F.lit(" of the later dates and may pass."))),
        F.when(F.col("shift_px") > settings.max_shift, "The images are out of line, which can widen edges."),
        F.when(F.col("cloud") > DRIFTED, F.concat(_percent(F.col("cloud")), F.lit(" of it was clouded on some date."))),
    )
    return with_shift(clusters, shift_px).withColumns({"evidence": evidence, "caveats": caveats}).drop("shift_px")


def findings(summary: DataFrame, mode: str, settings: Settings = SETTINGS) -> DataFrame:
    """(aoi, evidence, caveats) of one row an AOI of `stats` (with shift_px and the counts of detect.quality_counts): what speaks for the result and what limits it."""
    name, count = mode_index(mode), lambda c: F.format_number(F.col(c), 0)
    clear, drift, shift = F.col("valid_fraction"), F.col("index_shift"), F.col("shift_px")
    removed = F.col("gated") - F.col("cleaned")
    notes = {
        "urban_expansion": (
            F.when(F.col("dried") > 0, F.concat(count("dried"), F.lit(" pixels look built because water left them; dry lake bed is no construction and was left out."))),
            F.lit("Only pixels that look built in the last image count."),
        ),
        "vegetation_loss": (F.when(F.col("crossed") > 0, F.concat(count("crossed"), F.lit(" pixels went between water and land, where a plant index says nothing; they were left out."))),),
        "water_loss": (F.lit("Only pixels that crossed the edge of open water count, so muddy or shallow water does not."),),
        "burn_scar": (F.lit("Only ground that carried plants before counts as burned."),),
    }
    notes |= {"vegetation_gain": notes["vegetation_loss"], "water_gain": notes["water_loss"]}
    evidence = _sentences(
        F.when(clear >= settings.least_valid, F.concat(_percent(clear), F.format_string(" of the area is clear in both %d and %d.", "baseline_year", "latest_year"))),
        F.when(shift <= settings.max_shift, F.format_string(f"The images are in line to %.1f pixels (up to {settings.max_shift:.0f} is fine).", shift)),
        F.when(F.abs(drift) >= settings.report_shift, F.format_string(f"{name} moved by %+.3f in the whole scene; such an even change comes from light, air or season and was taken out.", drift))
        .otherwise(F.format_string(f"{name} moved by only %+.3f in the whole scene, so the dates compare well.", drift)),
        F.when(F.col("gate_rejected") > 0, F.concat(count("gate_rejected"), F.lit(" pixels ("), _percent(F.col("gate_rejected") / F.greatest("raw_hits", F.lit(1))), F.lit(" of the hits) were refused because their surface does not fit the change asked for."))),
        *notes.get(mode, ()),
        F.when((F.col("gated") > 0) & (removed > 0), F.concat(F.format_number(removed, 0), F.lit(" of "), count("gated"), F.lit(" hits ("), _percent(removed / F.col("gated")), F.lit(") were single pixels or patches too small to map."))),
        F.when(F.col("cloud_suppressed") > 0, F.concat(count("cloud_suppressed"), F.lit(" pixels were left out because a date shows cloud, shadow or snow there."))),
        F.when(F.col("epoch_count") >= 3, F.format_string("%d dates from %d to %d let every hit be tested for persistence.", "epoch_count", "baseline_year", "latest_year")),
        F.when(F.col("cluster_count") > 0, F.format_string("%d clusters passed every test: %.1f ha, %.2f %% of the analysed area.", "cluster_count", "changed_area_ha", "changed_percent")),
    )
    caveats = _sentences(
        F.when(clear < settings.least_valid, F.concat(F.lit("Only "), _percent(clear), F.lit(" of the area is clear in both end images; the rest could not be judged."))),
        F.when(shift > settings.max_shift, F.format_string("The images are about %.1f pixels out of line, which can feign change along edges.", shift)),
        F.when(F.col("epoch_count") < 3, "Only two dates were usable, so a passing state of the ground cannot be ruled out."),
        F.when(F.col("mean_cloud") > CLOUDY, F.format_string("The scenes are clouded by %.0f %% on average.", "mean_cloud")),
        F.when(F.col("cluster_count") == 0, "No cluster passed the tests of strength, persistence and size; by this measure the area is stable."),
    )
    return summary.select("aoi", evidence.alias("evidence"), caveats.alias("caveats"))


# ---- narrative and report -------------------------------------------------------------------------------------------------------------------------


def title_case(text: Column) -> Column:
    return F.initcap(text)


def narrative(summary: DataFrame, bias: DataFrame, onset: DataFrame, found: DataFrame, mode: str, place: str, proximity: str | None = None) -> DataFrame:
    """(aoi, headline, summary, confidence_text, so_what, recommendations, report) from one row an AOI of `stats`, `spatial_bias`, `onset_span` and `findings`.

    `report` holds the fields of a report in one struct.
    """
    called, why, whom, advice = CONTEXT[mode]
    name = mode_index(mode)
    title, formula, _ = INDEX_META[name]
    rows = summary.join(bias, "aoi", "left").join(onset, "aoi", "left").join(found, "aoi", "left")
    some, n, band = F.col("cluster_count") > 0, F.col("cluster_count"), F.col("band")
    at, area = F.lit(place), area_text(F.col("changed_area_ha"))
    years = F.format_string("between %d and %d", "baseline_year", "latest_year")
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    joined = lambda *parts: F.concat_ws(" ", _sentences(*parts))
    head = F.when(some, said(area, f" of {called} in ", at, " ", years, ", in ", n.cast("string"), F.when(n == 1, " cluster.").otherwise(" clusters."))).otherwise(said(f"No {called} of note in ", at, " ", years, "."))
    text = joined(
        said(F.col("epoch_count").cast("string"), " images of ", at, " from ", F.col("baseline_date").cast("string"), " to ", F.col("latest_date").cast("string"), ", all of one season, were compared."),
        F.format_string(f"Change is that of {name}, {formula}, on pixels of about %.0f m.", "pixel_size_m"),
        F.when(some, said(area, F.format_string(", %.2f %% of the ", "changed_percent"), area_text(F.col("analysed_area_ha")), " that could be judged, passed every test; the largest cluster has ", area_text(F.col("largest_cluster_ha")), "."))
        .otherwise(said("Of the ", area_text(F.col("analysed_area_ha")), " that could be judged, no patch was both strong and large enough to report.")),
        F.when(some & F.col("bias").isNotNull(), said("Most of it lies in the ", F.col("bias"), " part.")),
        F.when(some & (F.col("onsets") == 1), said("It began in ", F.col("first_onset").cast("string"), ".")).when(some & (F.col("onsets") > 1), F.format_string("It began between %d and %d, step by step.", "first_onset", "last_onset")),
    )
    sure = joined(
        said("Confidence is ", band, F.format_string(" (%.0f %%).", F.bround(F.col("confidence") * 100))),
        F.when(F.col("valid_fraction") >= 0.85, said(_percent(F.col("valid_fraction")), " of the area is clear on both end dates.")).otherwise(said("Only ", _percent(F.col("valid_fraction")), " of the area is clear on both end dates, which lowers it.")),
        F.when(F.col("epoch_count") >= 3, F.format_string("%d dates allow a test of persistence.", "epoch_count")).otherwise("Two dates allow no test of persistence."),
        F.when(F.col("shift_px") <= 2.0, F.format_string("The images are in line to %.1f pixels.", "shift_px")).otherwise(F.format_string("The images are %.1f pixels out of line.", "shift_px")),
        F.when(F.col("mean_persistence") > 0, said("Changes show in ", _percent(F.col("mean_persistence")), " of the later dates on average.")),
        F.when(band == "low", "Take it as a hint that needs a check, not as a finding."),
    )
    meaning = F.when(some, joined(F.lit(why), F.lit(f"It concerns {whom}."), F.lit(NEARBY.get(proximity)), F.lit(f"Next: {advice}"))).otherwise(said("A stable result gives ", at, f" a dated baseline for later looks. It concerns {whom}."))
    steps = _sentences(
        F.when(some, F.lit(advice)).otherwise("Nothing needs doing for this measure; a longer period may show more."),
        F.when(some, "Visit the largest and surest clusters first."),
        F.when(some & (band != "high"), "Look again over a wider period or in the season beside this one."),
        F.when(some & (F.col("low_confidence") > 0), F.format_string("%d clusters have a confidence below 70 %%: confirm them before use.", "low_confidence")),
        F.lit(CLOSING),
    )
    clean = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), sanitise)
    fields = {
        "title": said(title_case(F.lit(called)), ": ", at), "location": at, "period": F.format_string("%d–%d", "baseline_year", "latest_year"),
        "observation_dates": said(F.col("baseline_date").cast("string"), " to ", F.col("latest_date").cast("string")), "major_observation": sanitise(head),
        "estimated_affected_area": F.when(some, area).otherwise("none to report"), "affected_area_ha": F.col("changed_area_ha"), "cluster_count": n,
        "concentration": F.coalesce("bias", F.when(n == 1, "single cluster").otherwise("not applicable")), "confidence_percent": F.bround(F.col("confidence") * 100).cast("int"), "confidence_band": band,
        "indicator": F.lit(f"{name}, {title}"), "evidence": clean(F.col("evidence")), "limitations": clean(F.col("caveats")), "recommendations": clean(steps),
        "data_source": F.lit("Sentinel-2 surface reflectance"),
    }
    return rows.select("aoi", sanitise(head).alias("headline"), sanitise(text).alias("summary"), sanitise(sure).alias("confidence_text"), sanitise(meaning).alias("so_what"), clean(steps).alias("recommendations"), F.struct(*(c.alias(k) for k, c in fields.items())).alias("report"))


def _table(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    """(aoi, name): the lines of an AOI's rows in order, as one text."""
    kept = rows.select("aoi", F.struct(F.col(order).alias("o"), line.alias("line")).alias("x")).groupBy("aoi").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return kept.select("aoi", F.concat_ws("\n", F.transform("x", lambda x: x["line"])).alias(name))


def _cells(*values: Column) -> Column:
    return F.concat(F.lit("| "), reduce(lambda a, b: F.concat(a, F.lit(" | "), b), (F.coalesce(v.cast("string"), F.lit("-")) for v in values)), F.lit(" |"))


def markdown(question: str, story: DataFrame, summary: DataFrame, clusters: DataFrame, epochs: DataFrame) -> DataFrame:
    """(aoi, report): the narrative, its measures, the images (epochs: aoi, k, date, scene_id, cloud, valid_fraction), evidence, limits and the REPORT_CLUSTERS largest clusters, as one Markdown text an AOI.

    Every image is listed with its own share of usable pixels, whichever dates were dropped.
    """
    number = lambda c, digits: F.format_number(F.col(c), digits)
    place = F.format_string("%.4f, %.4f", "centre_lat", "centre_lon")
    listed = _table(clusters.where(F.col("id") <= REPORT_CLUSTERS), "id", _cells(F.col("id"), F.col("name"), number("area_ha", 2), place, F.format_string("%+.3f", "mean_delta"), _percent(F.col("persistence")), F.col("onset_year"), _percent(F.col("confidence"))), "listed")
    images = _table(epochs, "k", _cells(F.col("date"), F.col("scene_id"), F.format_string("%.1f %%", "cloud"), _percent(F.col("valid_fraction"))), "images")
    rows = story.join(summary.drop("report"), "aoi").join(listed, "aoi", "left").join(images, "aoi", "left")
    r = lambda c: F.col(f"report.{c}")
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    bullets = lambda xs: F.concat_ws("\n", F.transform(xs, lambda x: F.concat(F.lit("- "), x)))
    table = lambda head, body: said(f"| {' | '.join(head)} |\n|{'-|' * len(head)}\n", body)
    measures = {
        "Changed ground": r("estimated_affected_area"), "Share of the analysed area": F.format_string("%.2f %%", "changed_percent"), "Analysed ground": said(number("analysed_area_ha", 0), " ha"), "Clusters": F.col("cluster_count").cast("string"),
        "Largest cluster": said(number("largest_cluster_ha", 1), " ha"), "Pixel": F.format_string("about %.0f m", "pixel_size_m"), "Images": F.col("epoch_count").cast("string"), "Mean persistence": _percent(F.col("mean_persistence")),
    }
    parts = [
        said("# ", r("title")),
        said("Question: ", question, "  \nPlace: ", r("location"), "  \nPeriod: ", r("period"), " (", r("observation_dates"), ")  \nMeasure: ", r("indicator"), "  \nData: ", r("data_source")),
        F.lit("## Headline"), said("> ", r("major_observation")), said("Confidence: ", r("confidence_percent").cast("string"), " % (", F.upper(r("confidence_band")), ")"),
        F.lit("## Summary"), F.col("summary"), F.col("confidence_text"),
        F.lit("## Measures"), table(("Measure", "Value"), F.concat_ws("\n", *(_cells(F.lit(k), v) for k, v in measures.items()))),
        F.lit("## Images"), F.when(F.col("images").isNotNull(), table(("Date", "Scene", "Cloud", "Usable pixels"), F.col("images"))).otherwise("None."),
        F.lit("## Evidence"), bullets(r("evidence")),
        F.when(F.size(r("limitations")) > 0, said("## Limits\n\n", bullets(r("limitations")))),
        F.lit("## Meaning"), F.col("so_what"), F.lit("## Next"), bullets(F.col("recommendations")),
        F.when(F.col("listed").isNotNull(), said("## Clusters (", F.least("cluster_count", F.lit(REPORT_CLUSTERS)).cast("string"), " of ", F.col("cluster_count").cast("string"), ")\n\n", table(("#", "Change", "Hectares", "Centre", "Mean delta", "Persistence", "Onset", "Confidence"), F.col("listed")))),
        F.lit("---"), F.lit("Confidence is the strength of what the images show, not a legal status; confirm before acting."),
    ]
    return rows.select("aoi", F.concat_ws("\n\n", *parts).alias("report"))
