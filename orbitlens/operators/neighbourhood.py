"""Morphology and components over sets of pixels (aoi, r, c): offsets are exploded and counted, so every step is one hash aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["aoi", "r", "c"]


def _spread(pixels: DataFrame, centre: bool) -> DataFrame:
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if centre or i or j]
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    return pixels.select(*KEYS, F.explode(offsets).alias("o")).select("aoi", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))


def neighbour_filter(pixels: DataFrame, least: int = 2) -> DataFrame:
    """Pixels with at least `least` of their eight neighbours in the set."""
    near = _spread(pixels.select(*KEYS), False).groupBy(*KEYS).count().where(F.col("count") >= least)
    return pixels.join(near.select(*KEYS), KEYS, "left_semi")


def erode(pixels: DataFrame) -> DataFrame:
    """Pixels whose whole 3 x 3 neighbourhood is in the set; beyond the image nothing is."""
    return _spread(pixels.select(*KEYS), True).groupBy(*KEYS).count().where("count = 9").select(*KEYS)


def dilate(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return _spread(pixels.select(*KEYS), True).where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < height) & (F.col("c") < width)).distinct()


def close(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return erode(dilate(pixels, height, width))


def label_array(r: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
    """Least linear number of each pixel's 8-connected component: labels sink along sorted neighbour pairs until none moves."""
    ids = r.astype(np.int64) * width + c
    order = np.argsort(ids)
    ids, rs, cs = ids[order], r[order].astype(np.int64), c[order].astype(np.int64)
    ends = []
    for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)):
        want = (rs + i) * width + cs + j
        at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
        hit = (ids[at] == want) & (cs + j >= 0) & (cs + j < width)
        ends.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.empty(len(ids), np.int64)
    out[order] = ids[root]
    return out


def components(pixels: DataFrame, width: int) -> DataFrame:
    """(aoi, r, c, label): one task an AOI, whose pixels the analysis grid bounds."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=label_array(pdf["r"].to_numpy(), pdf["c"].to_numpy(), width))

    return pixels.select(*KEYS).groupBy("aoi").applyInPandas(label, "aoi long, r int, c int, label long")


def minimum_unit(labels: DataFrame, least: int) -> DataFrame:
    sizes = labels.groupBy("aoi", "label").count().where(F.col("count") >= least)
    return labels.join(sizes.select("aoi", "label"), ["aoi", "label"], "left_semi")


def phase_shift(before: np.ndarray, after: np.ndarray) -> tuple[float, float, float]:
    """Shift (rows, columns) between two images by phase correlation, and the sharpness of the peak; zeros if one image is flat."""
    images = [before.astype(float), after.astype(float)]
    if min(x.std() for x in images) < 1e-6:
        return 0.0, 0.0, 0.0
    taper = np.outer(np.hanning(before.shape[0]), np.hanning(before.shape[1]))
    f, g = (np.fft.rfft2((x - x.mean()) * taper) for x in images)
    cross = f * np.conj(g)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=before.shape)
    at = np.unravel_index(int(peak.argmax()), peak.shape)
    dy, dx = (float(a - n) if a > n // 2 else float(a) for a, n in zip(at, before.shape, strict=True))
    return dy, dx, float(peak.max() / (peak.std() + 1e-12))


def shifts(pixels: DataFrame, before: str, after: str, height: int, width: int) -> DataFrame:
    """(aoi, dy, dx, sharpness) between two images of every AOI, columns of (aoi, r, c, before, after); pixels without a row, or null, count as 0."""

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        images = np.zeros((2, height, width))
        images[:, pdf["r"], pdf["c"]] = np.nan_to_num(pdf[["before", "after"]].to_numpy(float).T)
        return pd.DataFrame([(pdf["aoi"].iloc[0], *phase_shift(*images))], columns=["aoi", "dy", "dx", "sharpness"])

    rows = pixels.select(*KEYS, F.col(before).alias("before"), F.col(after).alias("after"))
    return rows.groupBy("aoi").applyInPandas(measure, "aoi long, dy double, dx double, sharpness double")


def png_bytes(rgb: np.ndarray) -> bytes:
    """An RGB or RGBA image of bytes as PNG."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, bands = rgb.shape
    raw = np.concatenate((np.zeros((height, 1), np.uint8), rgb.reshape(height, width * bands).astype(np.uint8)), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6 if bands == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
