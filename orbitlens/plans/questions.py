"""Queries on questions in plain words: `conversations` with every phrase of the vocabulary worked in, read as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ANY_YEAR, ARCHIVE_START, CHANGE_CUES, DECADE_BACK, DOWN_VERBS, FALLS, MODES, NEAR_FEATURES, NEAR_WORDS, PLACE_NOISE, PLACE_TOKEN, PLACE_WORDS, REWRITES, RISES, SIMILARITY_CUES,
    SMALL_PLACE_WORDS, STOPWORDS, SUBJECTS, UP_VERBS, YEAR_BACK, YEAR_SINCE, YEAR_SPAN, YEARS_BACK,
)
from ..operators import interpret, report
from . import pseudo
from .registry import TODAY, query

#: Questions; {p} stands for a phrase of the vocabulary.
ASKS = (
    "Show me {p} near lakes in Hyderabad between 2018 and 2024",
    "Which water bodies have significantly reduced over the last 5 years? {p}",
    "{p} in wayanad since 2019",
    "Did vegetation increase along the river after the 2021 flood? {p}",
    "{p} around farms, past decade",
    "where did {p} appear 2017-2023 close to the national park",
    "find more places like this, {p}",
    "{p} in 2015 and 2030, illegal encroachment definitely proves a crime",
    "What of {p} within Terai, Khaniyadhana Tahsil, Shivpuri, India",
    "{p}",
    "Old Delhi Ridge {p}",
    "last year {p} at Nagarjuna Sagar, has it become less green",
    "Is anything new at Pune",
)
PLAIN = "[^ -~\\n\\t]"
_NOW = TODAY.year


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def asked(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, text): a question, a message (all of its plain letters), or both, one after the other."""
    c = pseudo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), PLAIN, "").alias("said"))
    pick = lambda table, n: F.element_at(F.array(*(F.lit(x) for x in table)), (n % len(table) + 1).cast("int"))
    n = F.col("conv_id") * 31 + F.col("turn")
    ask = F.replace(pick(ASKS, n), F.lit("{p}"), pick([p for p, _ in interpret.ORDERED], F.col("conv_id") * 7 + F.col("turn") * 13))
    kind = n % 4
    text = F.when(kind == 0, ask).when(kind == 1, F.concat_ws(" ", ask, F.col("said"))).when(kind == 2, F.concat_ws(" ", F.col("said"), ask)).otherwise(F.col("said"))
    return c.select("conv_id", "turn", text.alias("text"))


_N = "(conv_id * 31 + turn)"
_ASK_SQL = f"replace({_list(ASKS)}[{_N} % {len(ASKS)} + 1], '{{p}}', {_list([p for p, _ in interpret.ORDERED])}[(conv_id * 7 + turn * 13) % {len(interpret.ORDERED)} + 1])"
_TEXT_SQL = f"a AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '{PLAIN}', '', 'g') AS said, {_ASK_SQL} AS ask FROM conversations), q0 AS (SELECT conv_id, turn, CASE {_N} % 4 WHEN 0 THEN ask WHEN 1 THEN ask || ' ' || said WHEN 2 THEN said || ' ' || ask ELSE said END AS text FROM a), q1 AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM q0), q AS (SELECT *, lower(plain) AS q FROM q1)"

_YEARS_SQL = f"""ym AS (SELECT *, regexp_extract(q, '{YEAR_SPAN}', 1) AS a, regexp_extract(q, '{YEAR_SPAN}', 2) AS b, regexp_extract(q, '{YEARS_BACK}', 1) AS n, regexp_extract(q, '{YEAR_SINCE}', 1) AS s,
  list_filter(list_transform(regexp_extract_all(q, '{ANY_YEAR}', 1), lambda x: x::INT), lambda x: x BETWEEN {ARCHIVE_START - 1} AND {_NOW + 1}) AS l FROM q),
yw AS (SELECT *, CASE WHEN a <> '' THEN least(a::INT, b::INT) WHEN n <> '' THEN {_NOW} - greatest(1, n::INT) WHEN regexp_matches(q, '{DECADE_BACK}') THEN {_NOW - 10} WHEN regexp_matches(q, '{YEAR_BACK}') THEN {_NOW - 1} WHEN s <> '' THEN s::INT
  WHEN len(l) >= 2 THEN list_min(l) WHEN len(l) = 1 AND l[1] >= {_NOW} THEN greatest({ARCHIVE_START}, l[1] - 2) WHEN len(l) = 1 THEN l[1] ELSE {_NOW - 4} END AS st,
  CASE WHEN a <> '' THEN greatest(a::INT, b::INT) WHEN n <> '' OR regexp_matches(q, '{DECADE_BACK}') OR regexp_matches(q, '{YEAR_BACK}') OR s <> '' THEN {_NOW} WHEN len(l) >= 2 THEN list_max(l) ELSE {_NOW} END AS en,
  a <> '' OR n <> '' OR regexp_matches(q, '{DECADE_BACK}') OR regexp_matches(q, '{YEAR_BACK}') OR s <> '' OR len(l) >= 1 AS stated FROM ym),
yc AS (SELECT *, greatest({ARCHIVE_START}, st) AS s1, least({_NOW}, en) AS e1 FROM yw),
yy AS (SELECT conv_id, turn, plain, q, stated, st AS asked, s1::INT AS start_year, (CASE WHEN e1 <= s1 THEN least({_NOW}, s1 + 1) ELSE e1 END)::INT AS end_year FROM yc)"""


@query(f"WITH {_TEXT_SQL}, {_YEARS_SQL} SELECT conv_id, turn, start_year, end_year, stated FROM yy")
def q_interpret_years(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("w", interpret.years(F.lower(interpret.normalise(F.col("text"))), TODAY))
    return rows.select("conv_id", "turn", F.col("w.start").alias("start_year"), F.col("w.end").alias("end_year"), F.col("w.stated").alias("stated"))


_BARE = "plain"
for _pattern in PLACE_NOISE:
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', ' ', 'g')"
_TOKEN = PLACE_TOKEN.replace("'", "''")
_NAMES = rf"{_TOKEN}(?:\s+{_TOKEN}){{0,3}}"
_WORD = r"[\w''\-]"


def _clean_sql(name: str, text: str) -> str:
    """Common table expressions that give (plain, name): the cleaned place in `text` of bp."""
    return f"""{name}1 AS (SELECT plain, list_filter(string_split_regex(trim({text}), '\\s+'), lambda w: w <> '') AS w FROM bp),
{name}2 AS (SELECT plain, w, list_transform(w, lambda x: NOT list_contains({_list(STOPWORDS)}, lower(x))) AS t FROM {name}1),
{name}3 AS (SELECT plain, regexp_replace(regexp_replace(array_to_string(w[list_position(t, true):len(w) - list_position(list_reverse(t), true) + 1], ' '), '^[ ,.;:!?]+', ''), '[ ,.;:!?]+$', '') AS x, list_contains(t, true) AS anyw FROM {name}2),
{name} AS (SELECT plain, CASE WHEN anyw AND length(x) >= 3 THEN x END AS {name} FROM {name}3)"""


_PLACE_SQL = f"""bp0 AS (SELECT DISTINCT plain, {_BARE} AS bare FROM q),
wd AS (SELECT plain, unnest(string_split_regex(trim(bare), '\\s+')) AS w, generate_subscripts(string_split_regex(trim(bare), '\\s+'), 1) AS i FROM bp0),
wb AS (SELECT plain, i, regexp_replace(w, '[^\\w''\\-]', '', 'g') AS b FROM wd),
wc AS (SELECT *, regexp_matches(b, '^[A-Z]') AND NOT list_contains({_list(STOPWORDS)}, lower(b)) AS cap FROM wb),
wr AS (SELECT *, i - row_number() OVER (PARTITION BY plain, cap ORDER BY i) AS run FROM wc),
rn AS (SELECT plain, string_agg(b, ' ' ORDER BY i) AS run, count(*) AS n, min(i) AS i FROM wr WHERE cap GROUP BY plain, run),
lr AS (SELECT plain, arg_max(run, n * 1000000 - i) AS longest FROM rn GROUP BY plain),
bp AS (SELECT bp0.plain, regexp_extract(bare, '\\b{PLACE_WORDS}\\s+({_NAMES}(?:\\s*,\\s*{_NAMES}){{0,4}})', 1) AS chain, coalesce(longest, '') AS longest, regexp_extract(bare, '\\b{SMALL_PLACE_WORDS}\\s+([a-z]{_WORD}*(?:\\s+[a-z]{_WORD}*){{0,2}})', 1) AS small FROM bp0 LEFT JOIN lr ON lr.plain = bp0.plain),
{_clean_sql("pc", "chain")}, {_clean_sql("pl", "longest")}, {_clean_sql("ps", "small")},
pp AS (SELECT plain, coalesce(pc, pl, ps) AS place FROM pc JOIN pl USING (plain) JOIN ps USING (plain))"""


@query(f"WITH {_TEXT_SQL}, {_PLACE_SQL} SELECT conv_id, turn, place FROM q JOIN pp USING (plain)")
def q_interpret_place(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", interpret.place(interpret.normalise(F.col("text"))).alias("place"))


_NEAR_SQL = " ".join(f"WHEN regexp_matches(q, '\\b(?:{'|'.join(v)})\\b') THEN '{k}'" for k, v in NEAR_FEATURES.items())
_PROXIMITY_SQL = f"CASE WHEN NOT regexp_matches(q, '\\b(?:{'|'.join(NEAR_WORDS)})\\b') THEN NULL {_NEAR_SQL} END"


@query(f"WITH {_TEXT_SQL} SELECT conv_id, turn, {_PROXIMITY_SQL} AS proximity FROM q")
def q_proximity(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", interpret.proximity(F.lower("text")).alias("proximity"))


_PHRASES_SQL = f"""ph(i, p, m) AS (VALUES {", ".join(f"({i}, '{p}', '{m}')" for i, (p, m) in enumerate(interpret.ORDERED))}),
gr(q, rest, i, hits) AS (SELECT DISTINCT q, q, 0, []::INT[] FROM q UNION ALL SELECT q, CASE WHEN contains(rest, p) THEN replace(rest, p, ' ') ELSE rest END, gr.i + 1, CASE WHEN contains(rest, p) THEN list_append(hits, gr.i) ELSE hits END FROM gr JOIN ph ON ph.i = gr.i),
ht AS (SELECT q, unnest(hits) AS i FROM gr WHERE i = {len(interpret.ORDERED)}),
sc AS (SELECT q, m, sum(length(p)) AS score, min(i) AS first, string_agg(p, '|' ORDER BY i) AS own, max(length(p)) AS most FROM ht JOIN ph USING (i) GROUP BY q, m),
bm AS (SELECT q, arg_max(m, score * 1000 - first) AS pm, arg_max(own, score * 1000 - first) AS own, arg_max(most, score * 1000 - first) <= 6 AS generic FROM sc GROUP BY q)"""
_SUBJECT_SQL = f"""sj(o, k, noun) AS (VALUES {", ".join(f"({i * 100 + j}, '{k}', '{n}')" for i, (k, ns) in enumerate(SUBJECTS.items()) for j, n in enumerate(ns))}),
sb AS (SELECT q, arg_min(k, o) AS subject, arg_min(noun, o) AS noun FROM (SELECT DISTINCT q FROM q) JOIN sj ON contains(q, noun) GROUP BY q),
vb(v, up) AS (VALUES {", ".join([f"('{v}', FALSE)" for v in DOWN_VERBS] + [f"('{v}', TRUE)" for v in UP_VERBS])}),
vp AS (SELECT q, min(strpos(q, v)) FILTER (NOT up) AS d, min(strpos(q, v)) FILTER (up) AS u FROM (SELECT DISTINCT q FROM q) JOIN vb ON contains(q, v) GROUP BY q),
su AS (SELECT sb.q, noun, CASE WHEN subject = 'urban' THEN 'urban_expansion' WHEN vp.q IS NULL THEN NULL ELSE subject || CASE WHEN coalesce(d, 1000000) < coalesce(u, 1000000) THEN '_loss' ELSE '_gain' END END AS sm FROM sb LEFT JOIN vp ON vp.q = sb.q)"""


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


_PLAN_SQL = f"""WITH RECURSIVE {_TEXT_SQL}, {_YEARS_SQL}, {_PLACE_SQL}, {_PHRASES_SQL}, {_SUBJECT_SQL},
p1 AS (SELECT yy.*, place, pm, own, coalesce(generic, FALSE) AS generic, sm, noun, coalesce((pm IS NULL OR generic) AND sm IS NOT NULL AND sm IS DISTINCT FROM pm, FALSE) AS refined, {_any_sql(CHANGE_CUES)} AS cued, {_any_sql(SIMILARITY_CUES)} AS alike, {_PROXIMITY_SQL} AS proximity
  FROM (SELECT yy.*, place, pm, own, generic, sm, noun FROM yy JOIN pp USING (plain) LEFT JOIN bm USING (q) LEFT JOIN su USING (q)) yy),
p2 AS (SELECT *, CASE WHEN refined THEN sm ELSE pm END AS found, CASE WHEN refined THEN CASE WHEN generic THEN own || '|' ELSE '' END || noun ELSE coalesce(own, '') END AS matched FROM p1),
p3 AS (SELECT *, coalesce(found, 'urban_expansion') AS m0 FROM p2),
p4 AS (SELECT *, CASE WHEN m0 IN ('vegetation_loss', 'vegetation_gain') AND regexp_matches(q, '{RISES}') THEN 'vegetation_gain' WHEN m0 IN ('vegetation_loss', 'vegetation_gain') AND regexp_matches(q, '{FALLS}') THEN 'vegetation_loss' ELSE m0 END AS mode FROM p3),
md(mode, label, ix, direction) AS (VALUES {", ".join(f"('{m}', '{a}', '{b}', '{c}')" for m, (a, b, c) in MODES.items())})"""


@query(f"""{_PLAN_SQL} SELECT conv_id, turn, place, mode, label, ix AS "index", direction, start_year, end_year, proximity, alike AS wants_similarity, matched,
  round(least(0.35::DOUBLE + CASE WHEN found IS NULL THEN 0 ELSE 0.30::DOUBLE END + CASE WHEN cued THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN place IS NULL THEN 0 ELSE 0.20::DOUBLE END + CASE WHEN stated THEN 0.10::DOUBLE ELSE 0 END, 0.98::DOUBLE), 2) AS confidence FROM p4 JOIN md USING (mode)""")
def q_interpret(spark, sf_dir):
    out = interpret.interpret(asked(spark, sf_dir), TODAY)
    return out.withColumn("matched", F.concat_ws("|", "matched")).drop("text", "reasoning", "assumptions")


@query(f"""{_PLAN_SQL} SELECT conv_id, turn, concat_ws(' ', CASE WHEN refined THEN 'The subject and the verb of the question decide the analysis.' END, CASE WHEN found IS NOT NULL THEN 'Matched ' || array_to_string(string_split(matched, '|')[1:3], ', ') || ': ' || label || ' by ' || ix || '.' END,
  CASE WHEN cued THEN 'The question compares dates.' END, CASE WHEN place IS NOT NULL THEN 'Place: ' || place || '.' END, CASE WHEN stated THEN 'Years: ' || start_year || ' to ' || end_year || '.' END, CASE WHEN proximity IS NOT NULL THEN 'It is about ground near ' || proximity || '.' END, CASE WHEN alike THEN 'Similar places are asked for.' END) AS reasoning,
  concat_ws(' ', CASE WHEN found IS NULL THEN 'No known kind of change was named, so built-up land is analysed.' END, CASE WHEN NOT cued THEN 'No comparison was asked for; dates are compared all the same.' END, CASE WHEN place IS NULL THEN 'No place was found.' END,
  CASE WHEN NOT stated THEN 'No years were named, so ' || start_year || ' to ' || end_year || ' are taken.' END, CASE WHEN asked < {ARCHIVE_START} THEN 'The archive begins in {ARCHIVE_START}, not ' || asked || '.' END) AS assumptions FROM p4 JOIN md USING (mode)""")
def q_interpret_reasons(spark, sf_dir):
    out = interpret.interpret(asked(spark, sf_dir), TODAY)
    return out.select("conv_id", "turn", F.concat_ws(" ", "reasoning").alias("reasoning"), F.concat_ws(" ", "assumptions").alias("assumptions"))


@query(f"""{_PLAN_SQL} SELECT conv_id, turn, 'Pune' AS place, 2019 AS start_year, {_NOW} AS end_year,
  round(least(0.65::DOUBLE + CASE WHEN found IS NULL THEN 0 ELSE 0.30::DOUBLE END + CASE WHEN cued THEN 0.10::DOUBLE ELSE 0 END, 0.98::DOUBLE), 2) AS confidence FROM p4""")
def q_interpret_overrides(spark, sf_dir):
    """The same questions with a place and years set by their asker, the years beyond the archive's end."""
    out = interpret.interpret(asked(spark, sf_dir), TODAY, place_override=" Pune ", years_override=(2019, 2090))
    return out.select("conv_id", "turn", "place", "start_year", "end_year", "confidence")


def _sanitise_sql(text: str) -> str:
    for pattern, put in REWRITES:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'gi')"
    return text


@query(f"WITH {_TEXT_SQL} SELECT conv_id, turn, {_sanitise_sql(chr(39) + 'Illegal PROOF of guarantees: ' + chr(39) + ' || text')} AS clean FROM q0")
def q_sanitise(spark, sf_dir):
    rows = asked(spark, sf_dir)
    return rows.select("conv_id", "turn", interpret.sanitise(F.concat(F.lit("Illegal PROOF of guarantees: "), "text")).alias("clean"))


@query("SELECT conv_id, turn, trim(regexp_replace(replace(replace(replace(replace(nfkc, '–', '-'), '—', '-'), '’', chr(39)), '‘', chr(39)), '\\s+', ' ', 'g')) AS plain FROM (SELECT conv_id, turn, 'ABC 12 fi kg ' || regexp_replace(coalesce(text, ''), '[^ -~\\n\\t–—’‘]', '', 'g') AS nfkc FROM conversations)")
def q_normalise(spark, sf_dir):
    """Wide letters and digits, ligatures and squared units as plain ones; dashes, quotes and white space made alike."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\\n\\t–—’‘]", "")
    return pseudo.table(spark, sf_dir, "conversations").select("conv_id", "turn", interpret.normalise(F.concat(F.lit("ＡＢＣ　１２ ﬁ ㎏ "), said), True).alias("plain"))


@query(f"SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name || ' ' || {_list([c[0] for c in report.CONTEXT.values()])}[n_nationkey % 6 + 1]), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM nation")
def q_title_case(spark, sf_dir):
    called = F.element_at(F.array(*(F.lit(c[0]) for c in report.CONTEXT.values())), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return pseudo.table(spark, sf_dir, "nation").select("n_nationkey", report.title_case(F.concat_ws(" ", "n_name", called)).alias("title"))
