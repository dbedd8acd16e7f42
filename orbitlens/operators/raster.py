"""Rasters: level of a pyramid, resampling and warping to a grid, colours and images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    GAMMA, HEAT_HIGH, HEAT_LOW, HEAT_STOPS, IMAGE_SIDE, MASK_ALPHA, NO_DATA_HEAT, NO_DATA_SHADE, OVERLAY_COLOURS, OVERLAY_OPACITY, SCL_COLOURS, STRETCH_HIGH, STRETCH_LOW, THUMB_SIDE,
)
from ..functions.projection import project
from .neighbourhood import KEYS, erode, png_bytes

#: Source pixels an output pixel keeps along a side, and the most source pixels (in millions) of one read.
OVERSAMPLE, MAX_MPX = 4.0, 6.0
COLOURS = ("red", "green", "blue")
#: Points along each side of a box by which its outline in another reference system is found.
OUTLINE = 21


# ---- levels, grids, resampling ------------------------------------------------------------------------------------------------------------------


def overview_level(src_w: Column, src_h: Column, width: Column, height: Column, levels: Column) -> Column:
    """The pyramid level to read for a window of src_w x src_h source pixels shown on width x height.

    The coarsest level that still keeps OVERSAMPLE pixels a side, or a coarser one if only that holds the read below MAX_MPX.
    """
    need = F.least(src_w / F.greatest(width, F.lit(1)), src_h / F.greatest(height, F.lit(1))) / OVERSAMPLE
    mpx = src_w * src_h / 1e6
    least = F.sqrt(mpx / MAX_MPX)
    fine = F.array_max(F.filter(levels, lambda x: x <= need))
    enough = F.coalesce(F.array_min(F.filter(levels, lambda x: x >= least)), F.array_max(levels))
    return F.greatest(F.coalesce(fine, F.lit(1)), F.when(mpx > MAX_MPX, enough).otherwise(1), F.lit(1))


def outline(box: tuple[float, float, float, float], epsg: Column) -> Column:
    """Struct (left, bottom, right, top): the bounds of a box (w, s, e, n in degrees) in another reference system, by points along its sides."""
    w, s, e, n = box
    share = np.arange(OUTLINE + 1) / OUTLINE
    points = [(w + (e - w) * t, y) for t in share for y in (s, n)] + [(x, s + (n - s) * t) for t in share for x in (w, e)]
    table = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points))
    side = lambda i: F.transform(table, lambda p: project(p["lon"], p["lat"], epsg)[i])
    return F.struct(F.array_min(side(0)).alias("left"), F.array_min(side(1)).alias("bottom"), F.array_max(side(0)).alias("right"), F.array_max(side(1)).alias("top"))


def cell_lonlat(r: Column, c: Column, box: tuple, height: int, width: int) -> tuple[Column, Column]:
    """Longitude and latitude of a (fractional) cell's centre; row 0 is the northern one."""
    w, s, e, n = (float(x) for x in box)
    return F.lit(w) + (c + 0.5) / width * (e - w), F.lit(n) - (r + 0.5) / height * (n - s)


def _targets(pixels: DataFrame, group: list[str], height: int, width: int) -> DataFrame:
    cells = pixels.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("tr"), (F.col("id") % width).cast("int").alias("tc"))
    return pixels.select(*group).distinct().join(cells)


def _corners(cells: DataFrame, keep: list[str]) -> DataFrame:
    """The up to four source pixels (r, c) around each cell's place (y, x in source pixels), with `weight` by nearness, and `nearest` for the one that holds it."""
    ends = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]
    share = lambda c, o: F.abs(1 - F.col(o) - (F.col(c) - F.floor(c)))
    at = lambda c, o: (F.floor(c) + F.col(o)).cast("int")
    holds = lambda c, o: at(c, o) == F.floor(F.col(c) + 0.5)
    rows = cells.withColumn("o", F.explode(F.array(*ends)))
    rows = rows.select(*keep, "tr", "tc", at("y", "o.i").alias("r"), at("x", "o.j").alias("c"), (share("y", "o.i") * share("x", "o.j")).alias("weight"), (holds("y", "o.i") & holds("x", "o.j")).alias("nearest"))
    return rows.where("weight > 0")


def _weighted(v: str, missing: float | None = None) -> Column:
    known = F.col(v).isNotNull() if missing is None else F.col(v) != missing
    return F.try_divide(F.sum(F.when(known, F.col("weight") * F.col(v))), F.sum(F.when(known, F.col("weight"))))


def resample_nearest(pixels: DataFrame, values: list[str], group: list[str], source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """`values` of every cell of the target grid (height, width) over the same ground: those of the source pixel that holds its centre, null without one."""
    at = lambda c, n, m: F.floor((F.col(c) + 0.5) * n / m).cast("int")
    cells = _targets(pixels, group, *target).withColumns({"r": at("tr", source[0], target[0]), "c": at("tc", source[1], target[1])})
    out = cells.join(pixels.select(*group, "r", "c", *values), [*group, "r", "c"], "left")
    return out.select(*group, F.col("tr").alias("r"), F.col("tc").alias("c"), *values)


def resample_bilinear(pixels: DataFrame, values: list[str], group: list[str], source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """`values` of every cell of the target grid: the mean of the four source pixels around its centre, by nearness; missing and null ones take no part, null if all are."""
    place = lambda c, n, m: (F.col(c) + 0.5) * n / m - 0.5
    cells = _targets(pixels, group, *target).withColumns({"y": place("tr", source[0], target[0]), "x": place("tc", source[1], target[1])})
    rows = _corners(cells, group).join(pixels.select(*group, "r", "c", *values), [*group, "r", "c"], "left")
    return rows.groupBy(*group, "tr", "tc").agg(*(_weighted(v).alias(v) for v in values)).withColumnsRenamed({"tr": "r", "tc": "c"})


def warp(images: DataFrame, sources: DataFrame, keys: list[str], box: tuple, height: int, width: int, bands=("red", "green", "blue", "nir", "swir16")) -> DataFrame:
    """(keys, r, c, bands, scl) of every cell of a grid over `box`, read from the images that `sources` name.

    `images` (scene_id, level, r, c, bands, scl) hold raw numbers, 0 for no data; `sources` (keys, scene_id, level, epsg, x0, y0, dx, dy) give each one's reference
    system, its upper left corner and its pixel's size.  Bands are the mean of the four pixels around a cell's centre, by nearness and without those of no data, to
    the nearest whole number; the class is that of the pixel which holds the centre.  What no image holds is 0.
    """
    cells = images.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("tr"), (F.col("id") % width).cast("int").alias("tc"))
    cells = cells.join(F.broadcast(sources))  # a few scenes of one analysis
    x, y = project(*cell_lonlat(F.col("tr"), F.col("tc"), box, height, width), F.col("epsg"))
    cells = cells.withColumns({"x": (x - F.col("x0")) / F.col("dx") - 0.5, "y": (F.col("y0") - y) / F.col("dy") - 0.5})
    rows = _corners(cells, [*keys, "scene_id", "level"]).join(images.select("scene_id", "level", "r", "c", *bands, "scl"), ["scene_id", "level", "r", "c"], "left")
    means = [F.coalesce(F.floor(_weighted(b, 0) + 0.5), F.lit(0)).cast("int").alias(b) for b in bands]
    out = rows.groupBy(*keys, "tr", "tc").agg(*means, F.coalesce(F.max(F.when(F.col("nearest"), F.col("scl"))), F.lit(0)).cast("int").alias("scl"))
    return out.withColumnsRenamed({"tr": "r", "tc": "c"})


# ---- colours ------------------------------------------------------------------------------------------------------------------------------------


def _ends(pixels: DataFrame, sizes: dict[str, Column], group: list[str], low: float, high: float, floor: float) -> DataFrame:
    """`pixels` with `_name_lo` and `_name_hi` for each size: percentiles over the group's valid pixels, over all of them if none is valid; never nearer than `floor`."""
    share = F.array(F.lit(low), F.lit(high))
    q = pixels.groupBy(*group).agg(*(F.coalesce(F.percentile(F.when(F.col("valid"), size), share), F.percentile(size, share)).alias(f"_{b}") for b, size in sizes.items()))
    lo = lambda b: F.col(f"_{b}")[0]
    hi = lambda b: F.when(F.col(f"_{b}")[1] - lo(b) < floor, lo(b) + floor).otherwise(F.col(f"_{b}")[1])
    q = q.select(*group, *(x for b in sizes for x in (lo(b).alias(f"_{b}_lo"), hi(b).alias(f"_{b}_hi"))))
    return pixels.join(q, group)


def _share(size: Column, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (size - F.col(f"_{b}_lo")) / (F.col(f"_{b}_hi") - F.col(f"_{b}_lo"))))


def stretched(pixels: DataFrame, bands=COLOURS, group=("aoi",)) -> DataFrame:
    """`pixels` with each band as a display shade, 0 to 255: stretched between percentiles of the group's valid pixels, brightened a little; invalid pixels dark grey."""
    rows = _ends(pixels, {b: F.col(b) for b in bands}, list(group), STRETCH_LOW, STRETCH_HIGH, 1e-4)
    shade = lambda b: F.when(F.col("valid"), F.floor(255 * F.pow(_share(F.col(b), b), F.lit(1 / GAMMA)) + 1e-9)).otherwise(NO_DATA_SHADE).cast("int")
    return rows.select(*(shade(c).alias(c) if c in bands else F.col(c) for c in pixels.columns))


def heat_index(pixels: DataFrame, value: str, direction: str, group: str = "aoi") -> DataFrame:
    """`pixels` with `heat`, 0 to 255: where the change lies between percentiles over the valid pixels; null where not valid."""
    size = F.col(value) if direction == "increase" else -F.col(value)
    rows = _ends(pixels, {"heat": size}, [group], HEAT_LOW, HEAT_HIGH, 1e-6)
    return rows.select(*pixels.columns, F.when(F.col("valid"), F.floor(255 * _share(size, "heat")).cast("int")).alias("heat"))


def heat_colours(heat: Column) -> list[Column]:
    """Red, green and blue of a heat index: a linear mix of the stops around it; dark grey without one."""
    at, out = heat / 255.0, []
    for i, _ in enumerate(COLOURS):
        mixed = F.lit(HEAT_STOPS[-1][1][i])
        for (t0, c0), (t1, c1) in reversed(list(zip(HEAT_STOPS, HEAT_STOPS[1:], strict=False))):
            mixed = F.when(at <= t1, F.floor(c0[i] + (at - t0) / (t1 - t0) * (c1[i] - c0[i]) + 1e-9)).otherwise(mixed)
        out.append(F.when(heat.isNull(), NO_DATA_HEAT).otherwise(mixed).cast("int"))
    return out


def class_colours(scl: Column) -> list[Column]:
    """Red, green and blue of a class; black for a class that is none."""
    tables = [F.array(*(F.lit(x[i]) for x in SCL_COLOURS)) for i in range(3)]
    return [F.coalesce(F.get(t, scl.cast("int")), F.lit(0)) for t in tables]


def overlay(shades: DataFrame, labels: DataFrame, direction: str) -> DataFrame:
    """(aoi, r, c, red, green, blue): display shades (0 to 255) with changed pixels tinted and their outline white."""
    inner = erode(labels.select(*KEYS)).withColumn("inner", F.lit(True))
    rows = shades.join(labels.select(*KEYS).distinct().withColumn("hit", F.lit(True)), KEYS, "left").join(inner, KEYS, "left")
    tint = dict(zip(COLOURS, OVERLAY_COLOURS[direction], strict=True))
    mixed = lambda b: F.floor(F.col(b) * (1 - OVERLAY_OPACITY) + tint[b] * OVERLAY_OPACITY + 1e-9)
    colour = lambda b: F.when(F.col("hit") & F.col("inner").isNull(), 255).when(F.col("hit"), mixed(b)).otherwise(F.col(b)).cast("int")
    return rows.select(*KEYS, *(colour(b).alias(b) for b in tint))


# ---- images -------------------------------------------------------------------------------------------------------------------------------------


def _resized(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """One pass of a Lanczos resampling of three lobes along an axis, rounded to bytes."""
    n = image.shape[axis]
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    first = np.maximum((centre - 3 * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + 3 * wide + 0.5).astype(int), n)
    out = np.empty((size, *np.moveaxis(image, axis, 0).shape[1:]))
    source = np.moveaxis(image, axis, 0).astype(float)
    for i in range(size):
        t = (np.arange(first[i], last[i]) - centre[i] + 0.5) / wide
        weight = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)
        out[i] = np.tensordot(weight / weight.sum(), source[first[i] : last[i]], 1)
    return np.moveaxis(np.floor(out.clip(0, 255) + 0.5), 0, axis).astype(np.uint8)


def lanczos(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image (bytes) at another size, smoothly."""
    if image.shape[1] != width:
        image = _resized(image, width, 1)
    return _resized(image, height, 0) if image.shape[0] != height else image


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size by the pixel that holds each new one's centre."""
    rows = ((np.arange(height) + 0.5) * image.shape[0] / height).astype(int)
    columns = ((np.arange(width) + 0.5) * image.shape[1] / width).astype(int)
    return image[rows][:, columns]


def enlarge(image: np.ndarray, target: int = IMAGE_SIDE, smooth: bool = True) -> np.ndarray:
    """The image with its long side at `target` pixels; never smaller than it is."""
    height, width = image.shape[:2]
    if max(height, width) >= target:
        return image
    scale = target / max(height, width)
    return (lanczos if smooth else nearest)(image, max(1, int(height * scale)), max(1, int(width * scale)))


def _images(rows: DataFrame, group: list[str], columns: tuple[str, ...], height: int, width: int, finish, fill=NO_DATA_SHADE) -> DataFrame:
    """(group, png): one image a group of rows (group, r, c, columns); `finish` gives its final size."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.full((height, width, len(columns)), fill, np.uint8)
        own = pdf[pdf["r"].notna()]
        image[own["r"].astype(int), own["c"].astype(int)] = own[list(columns)].to_numpy().clip(0, 255)
        return pdf[group].iloc[:1].assign(png=[png_bytes(finish(image))])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "png binary"])
    return rows.select(*group, "r", "c", *columns).groupBy(*group).applyInPandas(one, schema)


def rgb_png(colours: DataFrame, height: int, width: int, target: int = IMAGE_SIDE, group=("aoi",)) -> DataFrame:
    """(group, png) of (group, r, c, red, green, blue); cells without a row are dark grey."""
    return _images(colours, list(group), COLOURS, height, width, lambda x: enlarge(x, target))


def thumb_png(colours: DataFrame, height: int, width: int, side: int = THUMB_SIDE, group=("aoi", "k")) -> DataFrame:
    """(group, png): small square images of (group, r, c, red, green, blue)."""
    return _images(colours, list(group), COLOURS, height, width, lambda x: lanczos(x, side, side))


def heat_png(heated: DataFrame, height: int, width: int, target: int = IMAGE_SIDE) -> DataFrame:
    """(aoi, png): heat maps of (aoi, r, c, heat); pixels without heat are dark grey."""
    colours = heated.select(*KEYS, *(x.alias(b) for b, x in zip(COLOURS, heat_colours(F.col("heat")), strict=True)))
    return _images(colours, ["aoi"], COLOURS, height, width, lambda x: enlarge(x, target), NO_DATA_HEAT)


def class_png(pixels: DataFrame, height: int, width: int, target: int = IMAGE_SIDE, group=("aoi",)) -> DataFrame:
    """(group, png): maps of the classes of (group, r, c, scl)."""
    colours = pixels.select(*group, "r", "c", *(x.alias(b) for b, x in zip(COLOURS, class_colours(F.col("scl")), strict=True)))
    return _images(colours, list(group), COLOURS, height, width, lambda x: enlarge(x, target), 0)


def masks_png(areas: DataFrame, labels: DataFrame, direction: str, height: int, width: int, target: int = IMAGE_SIDE) -> DataFrame:
    """(aoi, png): the change mask of every AOI of `areas` (aoi) as a transparent image; without change it is empty."""
    rows = areas.select("aoi").distinct().join(labels.select(*KEYS), "aoi", "left")
    colours = rows.select(*KEYS, *(F.lit(x).alias(b) for b, x in zip((*COLOURS, "alpha"), (*OVERLAY_COLOURS[direction], MASK_ALPHA), strict=True)))
    return _images(colours, ["aoi"], (*COLOURS, "alpha"), height, width, lambda x: enlarge(x, target, False), 0)


def png_pixels(images: DataFrame) -> DataFrame:
    """(aoi, r, c, red, green, blue, alpha) of the images (aoi, png) that this module writes; alpha is 255 without one."""
    import struct
    import zlib

    def one(parts):
        for pdf in parts:
            for aoi, png in zip(pdf["aoi"], pdf["png"], strict=True):
                width, height, _, kind = struct.unpack(">IIBB", png[16:26])
                at, data = 8, b""
                while at < len(png):
                    size = int.from_bytes(png[at : at + 4])
                    if png[at + 4 : at + 8] == b"IDAT":
                        data += png[at + 8 : at + 8 + size]
                    at += size + 12
                bands = 4 if kind == 6 else 3
                image = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * bands)[:, 1:].reshape(height * width, bands)
                r, c = np.divmod(np.arange(height * width), width)
                out = {"aoi": np.full(len(r), aoi), "r": r, "c": c, **{b: image[:, i] for i, b in enumerate(COLOURS)}}
                yield pd.DataFrame({**out, "alpha": image[:, 3] if bands == 4 else 255})

    return images.select("aoi", "png").mapInPandas(one, "aoi long, r int, c int, red int, green int, blue int, alpha int")


def data_uri(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))
