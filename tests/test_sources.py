import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from orbitlens.operators import detect, interpret, raster, signatures, study
from orbitlens.sources import files

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]


def feature(i, year, cloud, assets=("red", "green", "blue", "nir", "swir16", "scl")):
    return json.dumps({"id": f"s{i}", "properties": {"datetime": f"{year}-05-01T00:00:00Z", "eo:cloud_cover": cloud, "grid:code": "T1"}, "assets": {a: {"href": "x"} for a in assets}})


def test_search_scenes(spark, tmp_path):
    for year, rows in {2019: [feature(1, 2019, 5.0), feature(2, 2019, 30.0), feature(3, 2019, 1.0, ("red",)), "broken"], 2021: [feature(4, 2021, 19.0)]}.items():
        (tmp_path / f"year={year}").mkdir()
        (tmp_path / f"year={year}" / "a.json").write_text("\n".join(rows))
    ids = lambda a, b: sorted(r.id for r in files.search_scenes(spark, str(tmp_path), a, b).collect())
    assert ids(2019, 2021) == ["s1", "s4"]
    assert ids(2021, 2021) == ["s4"]
    (tmp_path / "year=2019" / "a.json").write_text(feature(2, 2019, 30.0))
    assert ids(2019, 2019) == ["s2"]


def test_geocode(spark):
    names = spark.createDataFrame([("Kokapet",), ("Far Town",), ("Nowhere",)], "query string")
    answers = spark.createDataFrame([("far town", "1.5", "2.5", ["1.0", "1.2", "2.0", "2.3"], "Far Town, Far Land"), ("nowhere", "x", "2", None, "?")], files.GEOCODER)
    got = {r["query"]: r for r in files.geocode(names, answers).collect()}
    assert got["Kokapet"].source == "gazetteer" and got["Far Town"].label == "Far Town, Far Land" and got["Nowhere"].source is None
    assert [round(x, 6) for x in got["Far Town"].box] == [2.0, 1.0, 2.3, 1.2]


def test_boundaries(spark):
    poly = {"type": "Polygon", "coordinates": [SQUARE, [[1, 1], [2, 1], [2, 2], [1, 1]]]}
    multi = {"type": "MultiPolygon", "coordinates": [[SQUARE], [[[20, 20], [21, 20], [20, 20]]]]}
    shapes = [("p", json.dumps(poly)), ("m", json.dumps(multi)), ("c", json.dumps({"type": "GeometryCollection", "geometries": [poly, {"type": "Point", "coordinates": [0, 0]}]})), ("x", "no json"), ("n", None)]
    edges = files.boundary_edges(spark.createDataFrame(shapes, "name string, geojson string"))
    assert {r["name"]: r["count"] for r in edges.groupBy("name").count().collect()} == {"p": 5, "m": 5, "c": 5}
    points = spark.createDataFrame([("p", 1, 5.0, 5.0), ("p", 2, 15.0, 5.0), ("x", 3, 5.0, 5.0)], "name string, pid int, lon double, lat double")
    assert {r.pid: r.inside for r in study.inside_boundary(points, edges).collect()} == {1: True, 2: False, 3: None}


@pytest.mark.parametrize("prefer", ["water", "other"])
def test_study_windows(spark, prefer):
    regions = spark.createDataFrame([("big", 0.0, 0.0, 9.0, 7.0), ("small", 0.0, 0.0, 1.0, 1.0), ("bare", 0.0, 0.0, 9.0, 7.0)], "name string, w double, s double, e double, n double")
    edges = files.boundary_edges(spark.createDataFrame([("big", json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 3.4], [0, 3.4], [0, 0]]]}))], "name string, geojson string"))
    heights = [(x + 0.5, y + 0.5, 10.0 * x + y + (0 if (x, y) != (0, 0) else 1)) for x in range(9) for y in range(7)]
    got = {r["name"]: r for r in study.study_windows(regions, edges, spark.createDataFrame(heights, "lon double, lat double, elevation double"), prefer).collect()}
    assert got["small"].method == "direct" and (got["small"].lon, got["small"].lat) == (0.5, 0.5)
    if prefer == "water":
        assert got["big"].elevation == 10.0 and got["big"].coverage == 1.0 and got["bare"].elevation == 5.0
    else:
        inside = sorted(h for x, y, h in heights if y < 3.4)
        assert got["big"].elevation == inside[len(inside) // 2]
    bare = study.study_windows(regions, edges, spark.createDataFrame([], "lon double, lat double, elevation double"), prefer)
    assert {r.method for r in bare.collect()} == {"direct", "in-country-centre"}


def test_pyramid(spark, tmp_path):
    px = spark.createDataFrame([(1, "s", r, c, r * 4 + c, 0, 0, 0, 0, 4) for r in range(4) for c in range(4)], "aoi int, scene_id string, r int, c int, red int, green int, blue int, nir int, swir16 int, scl int")
    files.write_pyramid(px, str(tmp_path), (1, 2))
    assert files.read_pyramid(spark, str(tmp_path), 1).count() == 16
    half = {(x.r, x.c): x.red for x in files.read_pyramid(spark, str(tmp_path), 2).collect()}
    assert half == {(0, 0): 10 / 3, (0, 1): 4.5, (1, 0): 10.5, (1, 1): 12.5}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert files.read_store(spark, path).count() == 0
    for seq in (1, 2):
        new = spark.createDataFrame([("a", seq, "A", 1.0, 2.0, "2016-2022", "m", [float(seq)], "-", 3.0)], files.STORE)
        files.write_store(signatures.upsert(files.read_store(spark, path), new), path)
    assert [(r.key, r.seq) for r in files.read_store(spark, path).collect()] == [("a", 2)]
    for _ in range(3):
        files.write_store(files.read_store(spark, path), path)
    assert len([x for x in (tmp_path / "store").iterdir()]) == files.OLD_VERSIONS + 1


def test_frames(spark, tmp_path):
    rows = spark.createDataFrame([(1, math.nan, [1.0, math.inf]), (2, 2.5, None)], "i int, x double, xs array<double>")
    files.write_frames(rows, str(tmp_path / "f"))
    (tmp_path / "f" / "extra.txt").write_text('{"i": 3,\n')
    got = files.read_frames(spark, str(tmp_path / "f"), "i int, x double, xs array<double>").orderBy("i").collect()
    assert [(r.i, r.x, r.xs) for r in got] == [(1, None, [1.0, None]), (2, 2.5, None)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Show urban expansion in Terai, Nepal between 2021 and 2025", "Terai, Nepal"),
        ("Show me water expansion", None),
        ("Which part of Old Delhi grew since 2019?", "Delhi"),
        ("Hyderabad Outer Ring growth", "Hyderabad Outer Ring"),
        ("lake loss around sambhar", "sambhar"),
        ("", None),
    ],
)
def test_place(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(interpret.place(interpret.normalise(F.col("t")))).first()[0]
    assert got == want


def lanczos_by_definition(image, height, width):
    """Both passes of the filter, one output value at a time."""

    def one_pass(image, size):
        n, out = image.shape[0], np.empty((size, *image.shape[1:]))
        scale = n / size
        wide = max(scale, 1)
        for i in range(size):
            at = (i + 0.5) * scale
            weights = [(j, (lambda t: 1.0 if t == 0 else 0.0 if abs(t) >= 3 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2)((j + 0.5 - at) / wide)) for j in range(max(0, int(at - 3 * wide + 0.5)), min(n, int(at + 3 * wide + 0.5)))]
            out[i] = sum(w * image[j].astype(float) for j, w in weights) / sum(w for _, w in weights)
        return np.floor(out.clip(0, 255) + 0.5)

    across = one_pass(image.swapaxes(0, 1), width).swapaxes(0, 1) if width != image.shape[1] else image
    return one_pass(across, height) if height != image.shape[0] else across


@pytest.mark.parametrize("size", [(32, 48), (7, 5), (10, 12), (20, 12)])
def test_lanczos(size):
    image = np.random.default_rng(2).integers(0, 256, (10, 12, 3)).astype(np.uint8)
    assert np.abs(raster.lanczos(image, *size).astype(int) - lanczos_by_definition(image, *size)).max() <= 1


def test_enlarge():
    assert raster.enlarge(np.zeros((10, 20, 3), np.uint8)).shape == (320, 640, 3)
    mask = np.eye(5, dtype=np.uint8)[:, :, None]
    assert (raster.enlarge(mask, 15, False) == np.kron(mask[:, :, 0], np.ones((3, 3), np.uint8))[:, :, None]).all()
    assert raster.enlarge(mask, 3) is mask


def test_frames_are_bounded():
    with pytest.raises(ValueError):
        detect.Frame(detect.MAX_SIDE + 1, 10)


def test_registration_finds_a_moved_scene(spark):
    image = np.random.default_rng(3).uniform(0.1, 0.9, (24, 24))
    rows = [(1, r, c, *(float(x) for i in (image, np.roll(image, (5, 0), (0, 1))) for x in (1 - i[r, c], i[r, c]))) for r in range(24) for c in range(24)]
    marked = spark.createDataFrame(rows, "aoi long, r int, c int, nir_b double, swir16_b double, nir_a double, swir16_a double")
    assert detect.registration(marked, "urban_expansion", detect.Frame(24, 24)).first().shift_px == 5
