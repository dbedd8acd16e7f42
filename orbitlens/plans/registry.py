"""The registry of queries and the SQL text of the detection chain that their oracles share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..constants import MODES, SETTINGS
from ..operators import neighbourhood
from . import pseudo

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = dt.date(2026, 6, 30)
KEYS = neighbourhood.KEYS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c, places_=6):
    return F.round(c, places_)


# ---- SQL text of the detection chain --------------------------------------------------------------------------------------------------------

S = SETTINGS
BANDS_OF = {"NDVI": ("nir", "red"), "NDBI": ("swir16", "nir"), "MNDWI": ("green", "swir16"), "NBR": ("nir", "swir16")}


def nd_sql(name: str, suffix: str = "") -> str:
    a, b = (x + suffix for x in BANDS_OF[name])
    return f"(CASE WHEN abs({a} + {b}) > 1e-6 THEN greatest((-1)::DOUBLE, least(1::DOUBLE, ({a} - {b}) / ({a} + {b}))) ELSE 0::DOUBLE END)"


WET_B, WET_A = (f"({nd_sql('MNDWI', s)} > 0.05)" for s in ("_b", "_a"))
GATES = {
    "urban_expansion": f"{nd_sql('NDBI', '_a')} > (-0.08) AND {nd_sql('NDVI', '_a')} < 0.30 AND NOT {WET_B} AND NOT {WET_A}",
    "vegetation_loss": f"{WET_B} = {WET_A}",
    "vegetation_gain": f"{WET_B} = {WET_A}",
    "water_gain": f"{WET_A} AND NOT {WET_B}",
    "water_loss": f"{WET_B} AND NOT {WET_A}",
    "burn_scar": f"{nd_sql('NDVI', '_b')} > 0.20 AND NOT {WET_B} AND NOT {WET_A}",
}


def scored_sql(mode: str, base: str | None = None) -> str:
    name, up = MODES[mode][1], MODES[mode][2] == "increase"
    hit = f"z >= {S.z_threshold} AND delta >= {S.min_delta}" if up else f"z <= -{S.z_threshold} AND delta <= -{S.min_delta}"
    bands = ", ".join(f"{t}.{b} AS {b}_{s}" for t, s in (("x", "b"), ("y", "a")) for b in ("nir", "red", "swir16", "green"))
    return f"""{base or pseudo.SQL},
ends AS (SELECT min(k) AS k0, max(k) AS k1 FROM px),
both_ AS (SELECT x.r, x.c, x.valid AND y.valid AS valid, {bands} FROM px x JOIN px y ON x.r = y.r AND x.c = y.c, ends WHERE x.k = k0 AND y.k = k1),
core AS (SELECT m.r, m.c FROM both_ m JOIN both_ n ON abs(m.r - n.r) <= 1 AND abs(m.c - n.c) <= 1 AND n.valid GROUP BY ALL HAVING count(*) = 9),
raw AS (SELECT both_.*, {nd_sql(name, "_a")} - {nd_sql(name, "_b")} AS raw FROM both_ JOIN core USING (r, c)),
mv AS (SELECT raw.*, raw - s AS delta, s AS shift FROM raw, (SELECT median(raw) AS s FROM raw)),
sc AS (SELECT mv.*, delta / sigma AS z FROM mv, (SELECT greatest(1e-4::DOUBLE, 1.4826::DOUBLE * median(abs(delta - m))) AS sigma FROM mv, (SELECT median(delta) AS m FROM mv))),
cd AS (SELECT *, {hit} AS raw_hit, {GATES[mode]} AS allowed FROM sc)"""


def labelled_sql(mode: str, base: str | None = None) -> str:
    return f"""{scored_sql(mode, base)},
hits AS (SELECT r, c FROM cd WHERE raw_hit AND allowed),
nb AS (SELECT m.r, m.c FROM hits m JOIN hits n ON abs(m.r - n.r) <= 1 AND abs(m.c - n.c) <= 1 AND (m.r <> n.r OR m.c <> n.c) GROUP BY ALL HAVING count(*) >= 2),
off AS (SELECT i.i, j.j FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j)),
dil AS (SELECT DISTINCT r + i AS r, c + j AS c FROM nb, off, hh WHERE r + i >= 0 AND c + j >= 0 AND r + i < h AND c + j < h),
clo AS (SELECT m.r, m.c FROM dil m JOIN dil n ON abs(m.r - n.r) <= 1 AND abs(m.c - n.c) <= 1 GROUP BY ALL HAVING count(*) = 9),
cl AS (SELECT clo.r, clo.c, (clo.r * h + clo.c)::BIGINT AS id FROM clo JOIN cd USING (r, c), hh WHERE allowed),
adj AS (SELECT a.id AS a, b.id AS b FROM cl a JOIN cl b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
walk AS (SELECT id AS a, id AS b FROM cl UNION SELECT walk.a, adj.b FROM walk JOIN adj ON adj.a = walk.b),
roots AS (SELECT a AS id, min(b) AS label FROM walk GROUP BY a),
lab AS (SELECT r, c, label FROM cl JOIN roots USING (id) WHERE label IN (SELECT label FROM roots GROUP BY label HAVING count(*) >= {S.min_unit}))"""


def with_sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_UP = nd_sql("NDBI")
#: After `labelled_sql("urban_expansion")`: v (index by epoch), base, pe (persistence).
PERSIST_SQL = f""", v AS (SELECT k, year, r, c, valid, {_UP} AS value FROM px),
base AS (SELECT r, c, delta, shift, {nd_sql("NDBI", "_b")} AS base, {nd_sql("NDBI", "_a")} AS last FROM cd),
pe AS (SELECT base.r, base.c, avg((value - base - shift * v.k / k1 >= greatest(abs(delta) * 0.5::DOUBLE, 0.05::DOUBLE))::INT) AS p FROM v JOIN base USING (r, c), ends WHERE v.k > 0 AND v.valid GROUP BY ALL)"""
#: After that: os (onset) and t2 (one row a cluster, with id, confidence and area in hectares of a hundredth a pixel).
CLUSTERS_SQL = f"""{PERSIST_SQL}, cv AS (SELECT r, c, (count(*) FILTER (valid) < (SELECT count(DISTINCT k) FROM px))::INT AS cloudy FROM px GROUP BY ALL),
t AS (SELECT label, count(*) AS n, avg(delta) AS md, max(delta) AS pd, avg(coalesce(p, 0)) AS ps, avg(lab.r) AS cr, avg(lab.c) AS cc, min(lab.r) AS r0, max(lab.r) + 1 AS r1, min(lab.c) AS c0, max(lab.c) + 1 AS c1, avg(cloudy) AS cl
  FROM lab JOIN cd USING (r, c) LEFT JOIN pe USING (r, c) JOIN cv USING (r, c) GROUP BY label),
em AS (SELECT label, k, year, avg(value) AS m FROM v JOIN lab USING (r, c) GROUP BY ALL),
ee AS (SELECT label, arg_min(m, k) AS m0, arg_max(m, k) AS m1 FROM em GROUP BY label),
os AS (SELECT label, min(year) AS onset_year FROM em JOIN ee USING (label) WHERE k > 0 AND CASE WHEN m1 > m0 THEN m >= m0 + 0.5::DOUBLE * (m1 - m0) ELSE m <= m0 + 0.5::DOUBLE * (m1 - m0) END GROUP BY label),
t2 AS (SELECT t.*, onset_year, row_number() OVER (ORDER BY n DESC, label)::INT AS id, n * 0.01::DOUBLE AS ha,
  greatest(0.05::DOUBLE, least(0.98::DOUBLE, 0.50::DOUBLE + 0.20::DOUBLE * least(abs(md) / 0.30::DOUBLE, 1) + 0.18::DOUBLE * ps + 0.08::DOUBLE * least(n / 400.0::DOUBLE, 1) - CASE WHEN cl > 0.10 THEN 0.12::DOUBLE * cl ELSE 0 END)) AS confidence FROM t LEFT JOIN os USING (label))"""
