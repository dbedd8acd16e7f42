import duckdb
import numpy as np
import pytest
from tests.conftest import SF, canonical
from orbitlens.constants import MODES, PHRASES
from orbitlens.operators import detect, interpret, neighbourhood, places
from orbitlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    spark.catalog.clearCache()
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_relaxed_search_with_cloudless_scenes(spark, duck, tmp_path):
    """Scenes without any cloud, or with a share below zero, pass any small limit; none of them may keep the relaxed one from holding."""
    prices = "CASE WHEN o_orderkey % 50 = 1 THEN 600.0 WHEN o_orderkey % 50 = 2 THEN -1.0 ELSE o_totalprice END::DOUBLE"
    duck.execute(f"COPY (SELECT * REPLACE ({prices} AS o_totalprice) FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = own.execute(catalog.ORACLES["q_scene_search_relaxed"]).df()
    assert (want["cloud"] == 0).any() and (want["cloud"] < 0).any() and (want["cloud"] > 20).any()
    assert canonical(catalog.QUERIES["q_scene_search_relaxed"](spark, str(tmp_path)).toPandas()) == canonical(want)


def test_pyramid_of_a_table_in_several_files(spark, tmp_path):
    """Averages that meet a half when rounded: they must not hang on how the rows are dealt to tasks.  One thread of the SQL's engine adds up in the rows' order."""
    own = duckdb.connect(config={"threads": 1})
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(8):
        rows = f"SELECT * EXCLUDE file_row_number REPLACE (CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS l_discount) FROM read_parquet('{SF}/../sf0.01/lineitem.parquet', file_row_number = true) WHERE file_row_number % 8 = {i}"
        own.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet/part-{i}.parquet' (FORMAT parquet)")
    own.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = canonical(own.execute(catalog.ORACLES["q_pyramid_level"]).df())
    for size in ("128m", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert canonical(catalog.QUERIES["q_pyramid_level"](spark, str(tmp_path)).toPandas()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_flagship_finds_the_city(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert len(rows) == 1 and rows[0]["pixel_count"] == 6


def brute_labels(mask):
    out, todo = {}, {tuple(p) for p in np.argwhere(mask)}
    while todo:
        stack, seen = [min(todo)], set()
        while stack:
            p = stack.pop()
            if p in todo:
                todo.discard(p)
                seen.add(p)
                stack += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        low = min(r * mask.shape[1] + c for r, c in seen)
        out |= dict.fromkeys(seen, low)
    return out


@pytest.mark.parametrize("density", [0.1, 0.4, 0.7])
def test_labels(density):
    mask = np.random.default_rng(3).random((23, 31)) < density
    r, c = np.nonzero(mask)
    got = neighbourhood.label_array(r, c, 31)
    want = brute_labels(mask)
    assert {(a, b): v for a, b, v in zip(r.tolist(), c.tolist(), got.tolist(), strict=True)} == {(int(a), int(b)): int(v) for (a, b), v in want.items()}


def test_erosion_and_closing_at_the_border(spark):
    rows = spark.createDataFrame([(1, r, c) for r in range(5) for c in range(5)], "aoi long, r int, c int")
    assert {(x.r, x.c) for x in neighbourhood.erode(rows).collect()} == {(r, c) for r in range(1, 4) for c in range(1, 4)}
    gap = rows.where("NOT (r = 2 AND c = 2)")
    assert (2, 2) in {(x.r, x.c) for x in neighbourhood.close(gap, 5, 5).collect()}


def test_phase_shift():
    a = np.random.default_rng(1).random((64, 64))
    dy, dx, sharp = neighbourhood.phase_shift(a, np.roll(a, (3, -2), (0, 1)))
    assert (abs(dy), abs(dx)) == (3, 2) and sharp > 5
    assert neighbourhood.phase_shift(np.ones((8, 8)), np.ones((8, 8))) == (0.0, 0.0, 0.0)


def test_png():
    data = neighbourhood.png_bytes(np.zeros((2, 3, 4), np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[-8:-4] == b"IEND"


def greedy(text):
    left, hits = text, []
    for p, m in interpret.ORDERED:
        if p in left:
            hits.append((p, m))
            left = left.replace(p, " ")
    return hits


def test_phrases_are_taken_longest_first(spark):
    asks = [f"{a} and {b}" for a, b in zip(PHRASES["urban_expansion"], [*PHRASES["water_gain"], *PHRASES["burn_scar"]], strict=False)] + ["", "nothing here"]
    rows = spark.createDataFrame([(a,) for a in asks], "q string")
    got = rows.select("q", interpret.phrase_hits(rows.q).alias("h")).collect()
    for row in got:
        assert [(x.p, x.m) for x in row.h] == greedy(row.q)


@pytest.mark.parametrize(
    ("ask", "mode", "start", "end"),
    [
        ("Show me urban expansion in Hyderabad between 2018 and 2024", "urban_expansion", 2018, 2024),
        ("which water bodies have significantly reduced over the last 5 years", "water_loss", 2021, 2026),
        ("where did vegetation increase since 2019", "vegetation_gain", 2019, 2026),
        ("burned area, past decade", "burn_scar", 2016, 2026),
        ("hello", "urban_expansion", 2022, 2026),
        ("flooding in 2026", "water_gain", 2024, 2026),
    ],
)
def test_plans(spark, ask, mode, start, end):
    plan = interpret.interpret(spark.createDataFrame([(ask,)], "text string"), catalog.TODAY).first()
    assert (plan["mode"], plan["start_year"], plan["end_year"], plan["index"]) == (mode, start, end, MODES[mode][1])


def test_null_question_and_unknown_place(spark):
    assert interpret.interpret(spark.createDataFrame([(None,)], "text string"), catalog.TODAY).first()["mode"] == "urban_expansion"
    assert places.look_up(spark.createDataFrame([("Zzzqqxx",)], "query string")).first()["key"] is None


def test_unknown_index():
    from orbitlens.functions.indices import index

    with pytest.raises(ValueError, match="unknown index"):
        index("EVI")


def test_stable_scene_has_no_clusters(spark):
    rows = [(1, k, 2016 + k, r, c, 0.40 + 0.001 * ((r * 7 + c * 3 + k) % 5), 0.06, 0.18, 0.08, 4, True) for k in range(3) for r in range(12) for c in range(12)]
    px = spark.createDataFrame(rows, "aoi long, k int, year int, r int, c int, nir double, red double, swir16 double, green double, scl int, valid boolean")
    assert detect.clusters(px, "vegetation_loss", detect.Frame(12, 12)).count() == 0
