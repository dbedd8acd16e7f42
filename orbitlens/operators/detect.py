"""Change detection over a long pixel table (aoi, k, year, r, c, nir, red, swir16, green, scl, valid): k numbers an AOI's epochs by date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLUSTER_NAMES, MAD_TO_SIGMA, MODES, OTHER_CLUSTER, SETTINGS, SIGMA_FLOOR, Settings
from ..functions.indices import confidence_band, gate, index, mode_index, passes_threshold
from ..scratch import saved
from .neighbourhood import KEYS, close, components, erode, minimum_unit, neighbour_filter, shifts
from .raster import cell_lonlat

_BANDS = ("nir", "red", "swir16", "green")


#: Largest side of a frame: an AOI's pixels fit in one task's memory when its components are labelled and its shift is measured.
MAX_SIDE = 2048


@dataclass(frozen=True)
class Frame:
    """The analysis grid that all epochs share; without a box (w, s, e, n) a pixel counts as a degree, from the upper left corner."""

    height: int
    width: int
    pixel_ha: float = 0.01
    box: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        if not 0 < max(self.height, self.width) <= MAX_SIDE:
            raise ValueError(f"a frame has 1 to {MAX_SIDE} pixels a side")

    @property
    def pixels(self) -> int:
        return self.height * self.width

    def lonlat(self, r: Column, c: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a (fractional) pixel's centre."""
        return cell_lonlat(r, c, self.box or (0.0, -float(self.height), float(self.width), 0.0), self.height, self.width)


def kept(df: DataFrame) -> DataFrame:
    """A stage that several later ones read: written once to the shared folder, so later plans stay short and lost executors cost nothing."""
    return df if hasattr(df, "scratch_path") else saved(df, "stage")


def pair(pixels: DataFrame) -> DataFrame:
    """One row a pixel that both end epochs have: bands before (_b) and after (_a) and whether both are valid.  One shuffle, no join of epochs."""
    ends = pixels.groupBy("aoi").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    state = F.struct("k", *_BANDS, "valid")
    both = pixels.groupBy(*KEYS).agg(F.min_by(state, "k").alias("b"), F.max_by(state, "k").alias("a"))
    both = both.join(ends, "aoi").where((F.col("b.k") == F.col("k0")) & (F.col("a.k") == F.col("k1")))
    return both.select(*KEYS, (F.col("b.valid") & F.col("a.valid")).alias("valid"), *(F.col(f"{s}.{x}").alias(f"{x}_{s}") for s in "ba" for x in _BANDS))


def core(both: DataFrame) -> DataFrame:
    return erode(both.where("valid"))


def scored(both: DataFrame, mode: str) -> DataFrame:
    """Core pixels with `raw` change of the mode's index, delta (without the scene-wide `shift`) and its robust z, by `sigma`."""
    name = mode_index(mode)
    both = kept(both)
    inside = kept(both.join(core(both), KEYS, "left_semi").withColumn("raw", index(name, "_a") - index(name, "_b")))
    shift = inside.groupBy("aoi").agg(F.median("raw").alias("shift"))
    moved = inside.join(shift, "aoi").withColumn("delta", F.col("raw") - F.col("shift"))
    # the median of delta is 0 now, so its deviations are its sizes
    spread = moved.groupBy("aoi").agg(F.greatest(F.lit(SIGMA_FLOOR), F.lit(MAD_TO_SIGMA) * F.median(F.abs("delta"))).alias("sigma"))
    return moved.join(spread, "aoi").withColumn("z", F.col("delta") / F.col("sigma"))


def candidates(pixels: DataFrame, mode: str, settings: Settings = SETTINGS, both: DataFrame | None = None) -> DataFrame:
    """Scored core pixels with `raw_hit` (threshold) and `allowed` (plausible); `both` gives the pairs where a caller has them already."""
    return scored(pair(pixels) if both is None else both, mode).withColumns({"raw_hit": passes_threshold(MODES[mode][2], settings), "allowed": gate(mode, settings)})


def cleaned(marked: DataFrame, frame: Frame) -> DataFrame:
    """Candidates after the neighbour filter and a closing that stays within plausible core pixels."""
    near = neighbour_filter(marked.where("raw_hit AND allowed").select(*KEYS))
    return close(near, frame.height, frame.width).join(marked.where("allowed").select(*KEYS), KEYS, "left_semi")


def labelled(marked: DataFrame, frame: Frame, settings: Settings = SETTINGS) -> DataFrame:
    marked = kept(marked)
    return minimum_unit(kept(components(cleaned(marked, frame), frame.width)), settings.min_unit)


def per_epoch(pixels: DataFrame, mode: str) -> DataFrame:
    return pixels.select("aoi", "k", "year", "r", "c", "valid", index(mode_index(mode)).alias("value"))


def persistence(pixels: DataFrame, marked: DataFrame, mode: str) -> DataFrame:
    """(aoi, r, c, persistence): share of a core pixel's later valid epochs that show at least half of its change."""
    up = MODES[mode][2] == "increase"
    epochs = per_epoch(pixels, mode)
    last = epochs.groupBy("aoi").agg(F.max("k").alias("k1"))
    base = marked.select(*KEYS, "delta", "shift", index(mode_index(mode), "_b").alias("base"))
    later = epochs.where("k > 0 AND valid").join(base, KEYS).join(last, "aoi")
    moved = F.col("value") - F.col("base") - F.col("shift") * F.col("k") / F.col("k1")
    bar = F.greatest(F.abs("delta") * 0.5, F.lit(0.05))
    hit = moved >= bar if up else moved <= -bar
    seen = later.groupBy(*KEYS).agg((F.count_if(hit) / F.count("*")).alias("persistence"))
    return marked.select(*KEYS).join(seen, KEYS, "left").withColumn("persistence", F.coalesce("persistence", F.lit(0.0)))


def onsets(pixels: DataFrame, labels: DataFrame, mode: str) -> DataFrame:
    """(aoi, label, onset_year): first later epoch whose mean has gone half of the way to the last one's; validity does not matter here."""
    means = per_epoch(pixels, mode).join(labels, KEYS).groupBy("aoi", "label", "k", "year").agg(F.avg("value").alias("m"))
    ends = means.groupBy("aoi", "label").agg(F.min_by("m", "k").alias("m0"), F.max_by("m", "k").alias("m1"))
    target = F.col("m0") + 0.5 * (F.col("m1") - F.col("m0"))
    crossed = F.when(F.col("m1") > F.col("m0"), F.col("m") >= target).otherwise(F.col("m") <= target)
    return means.join(ends, ["aoi", "label"]).where((F.col("k") > 0) & crossed).groupBy("aoi", "label").agg(F.min("year").alias("onset_year"))


def _stages(pixels: DataFrame, mode: str, frame: Frame, settings: Settings, scored_by: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    if scored_by:
        return pixels, *scored_by
    pixels = kept(pixels)
    marked = kept(candidates(pixels, mode, settings))
    return pixels, marked, kept(labelled(marked, frame, settings))


def registration(marked: DataFrame, mode: str, frame: Frame) -> DataFrame:
    """(aoi, shift_px, sharpness): how far the mode's index moved between the end epochs, over the core pixels of `candidates` (0 elsewhere)."""
    name = mode_index(mode)
    ends = marked.select(*KEYS, index(name, "_b").alias("first"), index(name, "_a").alias("last"))
    return shifts(ends, "first", "last", frame.height, frame.width).select("aoi", F.hypot("dy", "dx").alias("shift_px"), "sharpness")


def with_shift(rows: DataFrame, shift_px: float | DataFrame) -> DataFrame:
    """The rows with `shift_px`: one number, or each AOI's (0 where it has none)."""
    if isinstance(shift_px, DataFrame):
        return rows.join(shift_px.select("aoi", "shift_px"), "aoi", "left").fillna(0.0, ["shift_px"])
    return rows.withColumn("shift_px", F.lit(float(shift_px)))


def clusters(pixels: DataFrame, mode: str, frame: Frame, settings: Settings = SETTINGS, shift_px: float | DataFrame = 0.0, scored_by: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a component of at least the minimum unit, largest first (ties: least label): place, size, change, persistence, onset, confidence.

    `shift_px` is the registration shift of all, or (aoi, shift_px) as `registration` returns it.  `scored_by` gives the candidates and labels where a caller has them already.
    """
    pixels, marked, labels = _stages(pixels, mode, frame, settings, scored_by)
    up = MODES[mode][2] == "increase"
    rows = labels.join(marked.select(*KEYS, "delta"), KEYS).join(persistence(pixels, marked, mode), KEYS).join(clouded(pixels), KEYS)
    out = rows.groupBy("aoi", "label").agg(
        F.count("*").alias("pixel_count"),
        F.avg("delta").alias("mean_delta"),
        (F.max("delta") if up else F.min("delta")).alias("peak_delta"),
        F.avg("persistence").alias("persistence"),
        F.avg("r").alias("centre_r"),
        F.avg("c").alias("centre_c"),
        F.min("r").alias("r0"),
        (F.max("r") + 1).alias("r1"),
        F.min("c").alias("c0"),
        (F.max("c") + 1).alias("c1"),
        F.avg("cloudy").alias("cloud"),
    )
    epochs = pixels.groupBy("aoi").agg(F.count_distinct("k").alias("epochs"))
    out = with_shift(out.join(epochs, "aoi").join(onsets(pixels, labels, mode), ["aoi", "label"], "left"), shift_px)
    confidence = (
        F.lit(0.50)
        + 0.20 * F.least(F.abs("mean_delta") / 0.30, F.lit(1.0))
        + F.when(F.col("epochs") >= 3, 0.18 * F.col("persistence")).otherwise(0.0)
        + 0.08 * F.least(F.col("pixel_count") / 400.0, F.lit(1.0))
        - F.when(F.col("shift_px") > settings.max_shift, 0.10).otherwise(0.0)
        - F.when(F.col("cloud") > 0.10, 0.12 * F.col("cloud")).otherwise(0.0)
    )
    out = out.withColumn("confidence", F.greatest(F.lit(0.05), F.least(F.lit(0.98), confidence))).withColumn("band", confidence_band(F.col("confidence")))
    out = ranked(out)
    places = {}
    for end, r, c in (("centre", "centre_r", "centre_c"), ("first", "r0", "c0"), ("last", "r1", "c1")):
        at = (F.col(r) - 1, F.col(c) - 1) if end == "last" else (F.col(r), F.col(c))
        places[f"{end}_lon"], places[f"{end}_lat"] = frame.lonlat(*at)
    out = out.withColumns({"name": cluster_name(mode, F.col("persistence")), "area_ha": F.col("pixel_count") * frame.pixel_ha, **places})
    return out.withColumnsRenamed({"first_lon": "west", "first_lat": "north", "last_lon": "east", "last_lat": "south"}).drop("epochs", "shift_px")


def ranked(clusters: DataFrame) -> DataFrame:
    """The clusters (aoi, label, pixel_count and others) with `id`: 1 for an AOI's largest, ties by label."""
    return clusters.withColumn("id", F.row_number().over(Window.partitionBy("aoi").orderBy(F.desc("pixel_count"), "label")))


def cluster_name(mode: str, lasting: Column) -> Column:
    """What one cluster of a mode is called; those that most later epochs don't show are transient."""
    return F.concat(F.lit(CLUSTER_NAMES.get(mode, OTHER_CLUSTER)), F.when(lasting < 0.4, " (transient)").otherwise(""))


def clouded(pixels: DataFrame) -> DataFrame:
    """(aoi, r, c, cloudy): 1 where a pixel is not valid, or has no row, in one epoch of its AOI at least."""
    epochs = pixels.groupBy("aoi").agg(F.count_distinct("k").alias("epochs"))
    seen = pixels.groupBy(*KEYS).agg(F.count_if("valid").alias("seen"))
    return seen.join(epochs, "aoi").select(*KEYS, (F.col("seen") < F.col("epochs")).cast("int").alias("cloudy"))


def timeline(pixels: DataFrame, mode: str, frame: Frame, settings: Settings = SETTINGS, scored_by: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row an epoch: mean over the core, mean over the change (over the core if there is none), share that has changed, status, share of valid pixels.

    An epoch without a valid core pixel has null means, no change and the status stable.
    """
    up = MODES[mode][2] == "increase"
    pixels, marked, labels = _stages(pixels, mode, frame, settings, scored_by)
    labels = labels.withColumn("hot", F.lit(True)).select(*KEYS, "hot")
    anywhere = labels.groupBy("aoi").agg(F.lit(True).alias("any_hot"))
    area = marked.select(*KEYS, "shift", index(mode_index(mode), "_b").alias("base"), index(mode_index(mode), "_a").alias("last")).join(labels, KEYS, "left").join(anywhere, "aoi", "left")
    area = area.withColumn("hot", F.coalesce("hot", F.col("any_hot").isNull()))
    span = area.where("hot").groupBy("aoi").agg(F.avg("base").alias("hot0"), F.avg("last").alias("hot1"))
    epochs = per_epoch(pixels, mode)
    every = pixels.groupBy("aoi", "k", "year").agg((F.count_if("valid") / frame.pixels).alias("valid_fraction"))
    last = epochs.groupBy("aoi").agg(F.max("k").alias("k1"))
    rows = epochs.where("valid").join(area, KEYS).join(last, "aoi")
    moved = F.col("value") - F.col("base") - F.col("shift") * F.col("k") / F.greatest("k1", F.lit(1))
    changed = moved >= settings.min_delta if up else moved <= -settings.min_delta
    out = rows.groupBy("aoi", "k").agg(F.avg("value").alias("index_mean"), F.avg(F.when(F.col("hot"), F.col("value"))).alias("hotspot_mean"), (F.count_if(changed) / F.count("*")).alias("changed_fraction"))
    out = every.join(out, ["aoi", "k"], "left").fillna(0.0, ["changed_fraction"]).join(span, "aoi")
    return out.withColumn("status", timeline_status(F.col("k"), F.col("hotspot_mean"), F.col("hot0"), F.col("hot1"))).drop("hot0", "hot1")


def timeline_status(k: Column, hot: Column, first: Column, last: Column) -> Column:
    """How far an epoch's mean over the change has gone from the first epoch's to the last one's, in words; null means are no way gone."""
    way = last - first
    gone = F.when((F.abs(way) > 1e-6) & hot.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hot - first) / way))).otherwise(0.0)
    return F.when(k == 0, "stable").when(gone >= 0.75, "changed").when(gone >= 0.30, "emerging").otherwise("stable")


def side_counts(both: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(aoi, dried, crossed): pixels of `pair` that were water and look built afterwards, and those that are water in one end epoch alone; validity does not matter here."""
    wet_b, wet_a = index("MNDWI", "_b") > settings.water, index("MNDWI", "_a") > settings.water
    dried = wet_b & (index("NDBI", "_a") > settings.built)
    return both.groupBy("aoi").agg(F.count_if(dried).alias("dried"), F.count_if(wet_b != wet_a).alias("crossed"))


def quality_counts(pixels: DataFrame, mode: str, frame: Frame, settings: Settings = SETTINGS, scored_by: tuple[DataFrame, DataFrame] | None = None, both: DataFrame | None = None) -> DataFrame:
    """One row an AOI with core pixels: how the search for change went.

    core pixels and their share of the frame (valid_fraction), the scene-wide shift that was removed (index_shift) and the noise (sigma); threshold hits, those that
    are not plausible (gate_rejected), those that are (gated), what cleaning left (cleaned) and the share that it removed (noise_rejection: below 0 where closing added
    more, null without hits); pixels outside the core (cloud_masked), those of them that some epoch shows clouded (cloud_suppressed); and the side counts.
    """
    marked, labels = scored_by or (kept(candidates(pixels, mode, settings)), None)
    counts = marked.groupBy("aoi").agg(
        F.count("*").alias("core"), F.first("shift").alias("index_shift"), F.first("sigma").alias("sigma"),
        F.count_if("raw_hit").alias("raw_hits"), F.count_if(F.col("raw_hit") & F.col("allowed")).alias("gated"),
    )
    clean = (labelled(marked, frame, settings) if labels is None else labels).groupBy("aoi").agg(F.count("*").alias("cleaned"))
    cloud = clouded(pixels).join(marked.select(*KEYS, F.lit(1).alias("inside")), KEYS, "left")
    cloud = cloud.groupBy("aoi").agg(F.count_if(F.col("cloudy") == 0).alias("clear"), F.count_if((F.col("cloudy") == 1) & (F.col("inside") == 1)).alias("cloudy_core"))
    out = counts.join(clean, "aoi", "left").join(cloud, "aoi").join(side_counts(pair(pixels) if both is None else both, settings), "aoi", "left")
    out = out.fillna(0, ["cleaned", "dried", "crossed"]).withColumns({
        "valid_fraction": F.col("core") / frame.pixels,
        "gate_rejected": F.col("raw_hits") - F.col("gated"),
        "noise_rejection": F.try_divide(F.col("gated") - F.col("cleaned"), F.col("gated")),
        "cloud_masked": F.lit(frame.pixels) - F.col("core"),
        "cloud_suppressed": F.lit(frame.pixels) - F.col("clear") - F.col("cloudy_core"),
    })
    return out.drop("clear", "cloudy_core")


def usable_epochs(epochs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Epochs with enough valid pixels; if an AOI has fewer than two, its two best."""
    best = F.row_number().over(Window.partitionBy("aoi").orderBy(F.desc("valid_fraction"), "k"))
    good = F.count_if(F.col("valid_fraction") >= settings.usable_fraction).over(Window.partitionBy("aoi"))
    marked = epochs.withColumns({"best": best, "good": good})
    return marked.where(F.when(F.col("good") >= 2, F.col("valid_fraction") >= settings.usable_fraction).otherwise(F.col("best") <= 2)).drop("best", "good")


def cap_epochs(epochs: DataFrame, most: int) -> DataFrame:
    """First, the earliest of the others, and the last epoch: at most `most` an AOI."""
    n = F.count("*").over(Window.partitionBy("aoi"))
    return epochs.withColumn("n", n).where((F.col("k") < most - 1) | (F.col("k") == F.col("n") - 1)).drop("n")


def mosaic(rows: DataFrame, bands=("nir", "red", "swir16", "green"), keys=("aoi", "k", "r", "c")) -> DataFrame:
    """(keys, bands): where the primary (ord 0) has no SWIR, all bands of the first donor that has."""
    state = F.struct(*bands)
    out = rows.groupBy(*keys).agg(F.min_by(F.when(F.col("swir16") > 0, state), F.when(F.col("swir16") > 0, F.col("ord"))).alias("donor"), F.min_by(state, "ord").alias("own"))
    return out.select(*keys, F.coalesce("donor", "own").alias("x")).select(*keys, *(F.col(f"x.{b}").alias(b) for b in bands))
