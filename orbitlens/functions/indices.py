"""Spectral indices and pixel predicates as column expressions (all inside code generation)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DN_SCALE, INDEX_META, MODES, PEDESTAL, PEDESTAL_P01, PEDESTAL_PIXELS, REFLECTANCE_MAX, SCL_DEGRADED, SCL_INVALID, SETTINGS, Settings

BANDS = ("red", "green", "blue", "nir", "swir16")


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def nd(a: str, b: str) -> Column:
    """Normalised difference, 0 where the sum is about 0, held to [-1, 1]; null, NaN and infinite bands count as 0."""
    x, y = _finite(F.col(a)), _finite(F.col(b))
    return F.when(F.abs(x + y) > 1e-6, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x - y) / (x + y)))).otherwise(F.lit(0.0))


_BANDS = {"NDVI": ("nir", "red"), "NDBI": ("swir16", "nir"), "MNDWI": ("green", "swir16"), "NBR": ("nir", "swir16")}


def index(name: str, suffix: str = "") -> Column:
    """The index of that name over the bands red, green, nir and swir16 (with a suffix)."""
    try:
        a, b = _BANDS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown index {name!r}; known: {', '.join(_BANDS)}") from None
    return nd(a + suffix, b + suffix)


def reflectance(dn: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(REFLECTANCE_MAX), (dn - offset) * DN_SCALE))


def invalid_class(scl: str = "scl") -> Column:
    return F.col(scl).isin(*SCL_INVALID)


def degraded_class(scl: str = "scl") -> Column:
    return F.col(scl).isin(*SCL_DEGRADED)


def no_data(bands: Sequence[str] = BANDS) -> Column:
    """Whether all raw bands of a pixel are 0; a missing band counts as 0."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(b), F.lit(0)) == 0 for b in bands))


def usable_pixel(bands: Sequence[str] = BANDS, scl: str = "scl") -> Column:
    """Whether a pixel of raw bands may decide anything: its class is fit and it holds data; a missing class is class 0, no data."""
    return ~F.coalesce(F.col(scl), F.lit(0)).isin(*SCL_INVALID) & ~no_data(bands)


def pedestals(raw: DataFrame, keys: Sequence[str], swir: str = "swir16") -> DataFrame:
    """(keys, dark, pedestal): the first percentile of positive SWIR numbers, and the offset that all bands carry if even those are bright.

    Groups of PEDESTAL_PIXELS positive pixels or fewer, and those without any, have dark 0 and no offset.
    """
    seen = F.when(F.col(swir) > 0, F.col(swir))
    out = raw.groupBy(*keys).agg(F.percentile(seen, F.lit(0.01)).alias("p"), F.count(seen).alias("n"))
    dark = F.when(F.col("n") > PEDESTAL_PIXELS, F.col("p")).otherwise(0.0)
    return out.select(*keys, dark.alias("dark"), F.when(dark >= PEDESTAL_P01, F.lit(PEDESTAL)).otherwise(0).alias("pedestal"))


def index_table(spark: SparkSession) -> DataFrame:
    """(index, name, formula, bands) of all indices."""
    return spark.createDataFrame([(k, *v) for k, v in INDEX_META.items()], "index string, name string, formula string, bands string")


def shown(value: Column, digits: int) -> Column:
    """A number as results show it: rounded half to even; null and numbers that JSON can't hold give null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.bround(value, digits))


def escaped(text: Column) -> Column:
    """Text that is safe inside a page: the four signs of markup as entities; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def passes_threshold(direction: str, settings: Settings = SETTINGS) -> Column:
    z, d = F.col("z"), F.col("delta")
    if direction == "increase":
        return (z >= settings.z_threshold) & (d >= settings.min_delta)
    return (z <= -settings.z_threshold) & (d <= -settings.min_delta)


def gate(mode: str, settings: Settings = SETTINGS) -> Column:
    """Whether a change of this mode is plausible, from the bands before (_b) and after (_a)."""
    wet_b, wet_a = index("MNDWI", "_b") > settings.water, index("MNDWI", "_a") > settings.water
    if mode == "urban_expansion":
        return (index("NDBI", "_a") > settings.built) & (index("NDVI", "_a") < settings.vegetation) & ~wet_b & ~wet_a
    if mode in ("vegetation_loss", "vegetation_gain"):
        return wet_b == wet_a
    if mode == "water_gain":
        return wet_a & ~wet_b
    if mode == "water_loss":
        return wet_b & ~wet_a
    if mode == "burn_scar":
        return (index("NDVI", "_b") > settings.burn_before) & ~wet_b & ~wet_a
    return F.lit(True)


def mode_index(mode: str) -> str:
    return MODES[mode][1]


def circular_days(a: Column, b: Column) -> Column:
    """Days between two days of the year, the shorter way round."""
    d = F.abs(a - b) % 365
    return F.least(d, F.lit(365) - d)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.90, "high").when(c >= 0.70, "moderate").otherwise("low")


def area_text(ha: Column) -> Column:
    """Hectares for reading: square kilometres from 100 ha, square metres below 1 ha."""
    return (
        F.when(ha >= 100, F.format_string("%.2f km² (%s ha)", ha / 100, F.format_number(ha, 0)))
        .when(ha >= 1, F.format_string("%.1f ha", ha))
        .otherwise(F.format_string("%s m²", F.format_number(ha * 10000, 0)))
    )
