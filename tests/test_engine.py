"""Whole analyses: the regression questions on file-backed sources, every measure against plain numpy, and what a session holds."""

import itertools
import json
import math

import numpy as np
import pytest
from orbitlens.constants import MODES
from orbitlens.engine import STEPS, Engine, Request, StageError
from orbitlens.plans import catalog, pseudo
from orbitlens.scratch import Scratch, saved, scratch
from orbitlens.sources import archive as archives
from orbitlens.sources import files
from pyspark.sql import functions as F
from tests.conftest import SF

QUESTION = "Show urban expansion in Ringland between 2016 and 2022"
COUNTRY = (9.0, 48.9, 11.1, 50.9)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The pseudo-raster as an archive in files, with places, two countries and heights."""
    archive = pseudo.archive(spark, SF)
    w, s, e, n = pseudo.BOX
    town = [str(s), str(n), str(w), str(e)]
    places = ["terai, khaniyadhana tahsil, shivpuri, madhya pradesh, india", "kathmandu, nepal", "terai, nepal"]
    rows = [(p, "49.95", "10.05", town, p.title()) for p in places] + [(p, "49.9", "10.0", [str(COUNTRY[i]) for i in (1, 3, 0, 2)], p.title()) for p in ("nepal", "bangladesh")]
    archive.answers = archive.answers.unionByName(spark.createDataFrame(rows, files.GEOCODER))
    ring = [[COUNTRY[0], COUNTRY[1]], [COUNTRY[2], COUNTRY[1]], [COUNTRY[2], COUNTRY[3]], [COUNTRY[0], COUNTRY[3]], [COUNTRY[0], COUNTRY[1]]]
    shape = json.dumps({"type": "Polygon", "coordinates": [ring]})
    archive.boundaries = spark.createDataFrame([(p, shape, *COUNTRY) for p in ("Nepal", "Bangladesh")], files.BOUNDARY)
    cells = [(COUNTRY[0] + 2.1 * (i + 0.5) / 9, COUNTRY[1] + 2.0 * (j + 0.5) / 7) for j in range(7) for i in range(9)]
    archive.dem = spark.createDataFrame([(x, y, 6.0 if abs(x - 10.05) < 0.2 and abs(y - 49.9) < 0.2 else 0.0 if y < 49.1 else 50.0 + x) for x, y in cells], archives.DEM)
    path = str(tmp_path_factory.mktemp("archive"))
    archive.write(path)
    return path


CASES = [
    ("Check flood/water expansion changes in Terai, Khaniyadhana Tahsil, Shivpuri, Madhya Pradesh, India between 2016 and 2022 using Sentinel-2 imagery.", "result"),
    ("Check flood/water expansion changes in Nepal between 2016 and 2022 using Sentinel-2 imagery.", "result"),
    ("Check flood/water expansion changes in Kathmandu, Nepal between 2016 and 2022.", "any"),
    ("Check flood/water expansion changes in Terai, Nepal between 2016 and 2022.", "any"),
    ("Check flood/water expansion changes in Bangladesh between 2016 and 2022.", "any"),
    ("Show water expansion in Antarctica between 2021 and 2022.", "any"),
    ("Show water expansion in Zzzqqxx Nowhereland between 2021 and 2025.", "graceful_error"),
    ("Show me water expansion", "graceful_error"),
]


@pytest.mark.parametrize(("question", "expected"), CASES)
def test_regression(spark, folder, question, expected):
    events = list(Engine(spark, folder, today=catalog.TODAY).analyze(question, grid=64))
    last = events[-1]
    assert [e["status"] for e in events].count("error") == (last["status"] == "error") and last["step"] != "error"
    assert STEPS.index(last["step"]) >= STEPS.index("locate")
    if expected == "result":
        assert last["step"] == "complete" and last["stats"][0]["epoch_count"] >= 2
    if expected == "graceful_error":
        assert last["status"] == "error"
    if "in Nepal" in question:
        place = next(e["place"] for e in events if "place" in e)
        w, s, e, n = place["box"]
        assert place["reduced"] and place["study_area"]["method"] == "lowest-land-in-country" and place["study_area"]["elevation"] == 6.0
        assert math.isclose(e - w, 0.5) and math.isclose(n - s, 0.5) and w < 10.05 < e and s < 49.95 < n


def neighbours(mask):
    wide = np.pad(mask.astype(int), 1)
    return sum(wide[1 + i : 1 + i + mask.shape[0], 1 + j : 1 + j + mask.shape[1]] for i, j in itertools.product((-1, 0, 1), repeat=2))


def ratio(a, b):
    return np.where(np.abs(a + b) > 1e-6, np.clip((a - b) / np.where(a + b == 0, 1, a + b), -1, 1), 0)


def labels_of(mask):
    out = np.full(mask.shape, -1)
    for r, c in np.argwhere(mask):
        if out[r, c] >= 0:
            continue
        todo, name = [(r, c)], r * mask.shape[1] + c
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and out[y, x] < 0:
                out[y, x] = name
                todo += [(y + i, x + j) for i, j in itertools.product((-1, 0, 1), repeat=2)]
    return out


def by_hand(px, frame, mode):
    """Clusters and measures of a mode from dense arrays, each step by its definition."""
    epochs = sorted(px["k"].unique())
    band = {b: np.zeros((len(epochs), frame.height, frame.width)) for b in ("red", "green", "nir", "swir16")}
    valid = np.zeros((len(epochs), frame.height, frame.width), bool)
    for b, out in [*band.items(), ("valid", valid)]:
        out[px["k"], px["r"], px["c"]] = px[b]
    ndvi, ndbi, mndwi = (ratio(band[a], band[b]) for a, b in (("nir", "red"), ("swir16", "nir"), ("green", "swir16")))
    index = {"NDVI": ndvi, "NDBI": ndbi, "MNDWI": mndwi, "NBR": -ndbi}[MODES[mode][1]]
    up = MODES[mode][2] == "increase"
    core = neighbours(valid[0] & valid[-1]) == 9
    raw = index[-1] - index[0]
    shift = np.median(raw[core])
    delta = raw - shift
    sigma = max(1e-4, 1.4826 * np.median(np.abs(delta[core] - np.median(delta[core]))))
    strong = (delta / sigma >= 2.2) & (delta >= 0.10) if up else (delta / sigma <= -2.2) & (delta <= -0.10)
    wet = mndwi > 0.05
    gate = {
        "urban_expansion": (ndbi[-1] > -0.08) & (ndvi[-1] < 0.30) & ~wet[0] & ~wet[-1], "vegetation_loss": wet[0] == wet[-1], "water_gain": wet[-1] & ~wet[0], "water_loss": wet[0] & ~wet[-1],
        "burn_scar": (ndvi[0] > 0.20) & ~wet[0] & ~wet[-1],
    }[mode]
    hits = strong & core & gate
    clean = hits & (neighbours(hits) - hits >= 2)
    clean = (neighbours(neighbours(clean) > 0) == 9) & core & gate
    label = labels_of(clean)
    sizes = {i: int((label == i).sum()) for i in np.unique(label) if i >= 0}
    big = [i for i in sizes if sizes[i] >= 6]
    kept = np.isin(label, big)
    n = len(epochs) - 1
    moved = [index[k] - index[0] - shift * k / n for k in range(n + 1)]
    bar = np.maximum(0.5 * np.abs(delta), 0.05)
    agree = sum(((moved[k] >= bar) if up else (moved[k] <= -bar)) & valid[k] & core for k in range(1, n + 1))
    lasting = agree / np.maximum(sum(valid[k] & core for k in range(1, n + 1)), 1)
    rows = []
    for name in sorted(big, key=lambda i: (-sizes[i], i)):
        own = label == name
        first, last = index[0][own].mean(), index[-1][own].mean()
        onset = next((k for k in range(1, n + 1) if (index[k][own].mean() >= (first + last) / 2 if last > first else index[k][own].mean() <= (first + last) / 2)), None)
        rows.append((sizes[name], round(delta[own].mean(), 4), round(lasting[own].mean(), 3), None if onset is None else 2016 + onset))
    total = int(kept.sum())
    stats = {
        "core": int(core.sum()), "raw_hits": int((strong & core).sum()), "gated": int(hits.sum()), "cleaned": total, "cluster_count": len(big), "changed_pixels": total, "cloud_masked": int((~core).sum()),
        "cloud_suppressed": int(((~valid).any(0) & ~core).sum()), "dried": int((wet[0] & (ndbi[-1] > -0.08)).sum()), "crossed": int((wet[0] != wet[-1]).sum()),
        "index_shift": round(shift, 4), "sigma": round(sigma, 4), "changed_area_ha": round(total * frame.pixel_ha, 2),
    }
    return rows, stats


@pytest.mark.parametrize("mode", ["urban_expansion", "vegetation_loss", "water_gain", "water_loss", "burn_scar"])
def test_analysis_by_hand(spark, folder, mode):
    asked = {"urban_expansion": "urban expansion", "vegetation_loss": "deforestation", "water_gain": "flooding", "water_loss": "lake shrinking", "burn_scar": "wildfire"}[mode]
    engine = Engine(spark, folder, today=catalog.TODAY)
    events = list(engine.analyze(f"Show {asked} in Ringland between 2016 and 2022", grid=64))
    assert events[-1]["step"] == "complete" and events[1]["plan"]["mode"] == mode, events[-1]
    rows, stats = by_hand(engine.last["pixels"].toPandas(), engine.last["frame"], mode)
    told = events[-1]["stats"][0]
    assert {k: told[k] for k in stats} == pytest.approx(stats, abs=2e-4)
    mine = [(c["pixel_count"], c["mean_delta"], c["persistence"], c.get("onset_year")) for c in next(e["clusters"] for e in events if "clusters" in e)]
    assert len(mine) == min(len(rows), 20)
    for a, b in zip(mine, rows, strict=False):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=2e-4) and a[2] == pytest.approx(b[2], abs=2e-3) and a[3] == b[3]


def test_engine_session(spark, folder, tmp_path):
    engine = Engine(spark, folder, store=str(tmp_path / "store"), today=catalog.TODAY)
    with pytest.raises(StageError):
        engine.report()
    with pytest.raises(StageError):
        engine.similar()
    events = list(engine.analyze(Request(QUESTION, grid=64)))
    assert [e["step"] for e in events if e["status"] == "done"] == list(STEPS)
    text = engine.report().first().report
    assert "Ringland" in text and "| 1 | New built-up surface" in text and "2016-05-01" in text
    assert engine.similar().count() == 4 and engine.last["key"] not in [r.key for r in engine.similar().collect()]
    for name in ("before", "after", "overlay", "mask", "heatmap", "scl_before", "scl_after"):
        assert engine.image(name).startswith("data:image/png;base64,iVBOR")
    assert engine.thumb_of_year(2018).startswith("data:image/png") and engine.thumb_of_year(1999) is None and engine.image("none") is None
    first = engine.last["stats"]
    assert list(engine.analyze(Request(QUESTION, start=2016, end=2020, grid=64)))[-1]["step"] == "complete"
    with pytest.raises(Exception):  # noqa: B017  (the first analysis' tables are gone)
        first.count()
    kept = files.read_store(spark, str(tmp_path / "store")).orderBy("seq").collect()
    assert [r.period for r in kept] == ["2016-2022", "2016-2020"] and all(len(r.vector) == 13 and r.headline for r in kept)
    assert engine.health()["status"] == "ok" and engine.examples().count() == 6
    plan = engine.interpret("ＵＲＢＡＮ growth", place="Pune", start=2010, end=2020)
    assert (plan["mode"], plan["place"], plan["start_year"]) == ("urban_expansion", "Pune", 2016) and plan["assumptions"]


def test_box_and_companions(spark, folder):
    """A box of the asker's own is used as it is, clamped; cells that a scene does not cover come from its neighbour of the same day."""
    archive = archives.Archive.open(spark, folder)
    half = (F.col("scene_id") == "S2016") & (F.col("c") >= 7)
    other = archive.images.where(half).withColumn("scene_id", F.lit("X2016"))
    archive.images = archive.images.where(~half).unionByName(other)
    archive.footprints = archive.footprints.unionByName(archive.footprints.where("scene_id = 'S2016'").withColumn("scene_id", F.lit("X2016")))
    mate = archive.features.where("year = 2016").select(F.replace(F.replace("feature", F.lit('"S2016"'), F.lit('"X2016"')), F.lit('"T1"'), F.lit('"T2"')).alias("feature"), "year")
    archive.features = archive.features.unionByName(mate)
    engine = Engine(spark, archive, today=catalog.TODAY)
    events = list(engine.analyze(Request(QUESTION, bbox=pseudo.BOX, grid=64)))
    assert events[-1]["step"] == "complete", events[-1]
    assert events[3]["place"]["source"] == "box" and tuple(events[3]["grid"]["bounds"]) == pseudo.BOX
    filled = {r.year: r.filled_fraction for r in engine.last["epochs"].collect()}
    assert 0.3 < filled[2016] < 0.6 and not any(v for y, v in filled.items() if y != 2016)


def test_scratch_scopes(spark):
    from pathlib import Path

    rows = spark.range(3)
    with scratch() as outer:
        with scratch() as own:
            kept, lost = own.keep(saved(rows, "kept")), saved(rows, "lost")
        exists = lambda t: Path(t.scratch_path.removeprefix("file://")).exists()
        assert exists(kept) and not exists(lost) and kept.count() == 3
        assert kept.scratch_path in outer.tables
    assert not exists(kept)
    held = Scratch()
    with held:
        table = saved(rows, "held")
    assert exists(table)
    held.close()
    assert not exists(table)
