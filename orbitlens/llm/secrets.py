"""Secret scan over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived on the driver: every text that the expression matches holds all trigrams of one of the query's
alternatives (after Cox, 2012).  Postings list, for each trigram that a query names, the texts that hold it; the alternatives' postings are intersected
and the surviving texts verified with the expression itself.  A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  `group` of a match must have `least` characters, else the match is dropped (its characters stay consumed)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The contract's kinds.  For `access` and `hex` the least length stands in the pattern: a run that is too short can't hold a longer match.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds, reported in `spans` only.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
MARK = "[REDACTED]"
_KEY, _RULES = "__text_key", "__text_rules"
#: Strings that a run of literals may stand for before it is cut.
_MOST = 64
#: Items of an array that are folded at a time; characters of a piece of text that stretches are cut from.
FOLD, PIECE = 256, 4096


def _strings(node) -> set[str] | None:
    """All strings that a parsed item can match, or None if they are too many."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN:
        out = set()
        for kind, v in arg:
            if kind is C.LITERAL:
                out.add(chr(v))
            elif kind is C.RANGE and v[1] - v[0] < _MOST:
                out |= {chr(i) for i in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        sets = [_sequence(x) for x in arg[1]]
        return set().union(*sets) if all(x is not None for x in sets) else None
    if op is C.MAX_REPEAT and arg[1] <= 2:
        one = _sequence(arg[2])
        if one is not None:
            return set().union(*({"".join(x) for x in itertools.product(one, repeat=n)} for n in range(arg[0], arg[1] + 1)))
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for x in items:
        s = _strings(x)
        if s is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(pattern: str, any_case: bool = False) -> list[list[frozenset[str]]]:
    """Conjunction of disjunctions of trigram sets that every match implies; empty if nothing is mandatory."""
    clauses, run = [], {""}

    def close():
        nonlocal run
        options = {frozenset((x.lower() if any_case else x)[i : i + 3] for i in range(len(x) - 2)) for x in run}
        options = {x for x in options if not any(y < x for y in options)}  # a weaker alternative covers a stronger one
        if frozenset() not in options:
            clauses.append(sorted(options, key=sorted))
        run = {""}

    for item in _parser.parse(pattern):
        s = _strings(item)
        if s is not None and len(run) * len(s) <= _MOST:
            run = {a + b for a in run for b in s}
        else:
            close()
            if s is not None:
                run = s
    close()
    return clauses


def _folded(items: Column, kind: str, emit) -> Column:
    """Structs (at, out) of a fold over an array, FOLD items each: `emit` takes the state `at` and an item and gives the next state and an array of results, of type `kind`.

    Results are gathered by the chunk, so an array of n items is copied about n * FOLD / 2 times in all, not n * n / 2.
    """
    none = F.array().cast(f"array<{kind}>")

    def step(acc, x):
        at, out = emit(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def chunk(done, i):
        start = F.struct(F.when(F.size(done) > 0, F.get(done, F.size(done) - 1)["at"]).otherwise(0).alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(F.slice(items, i * FOLD + 1, FOLD), start, step)))

    chunks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(chunks, F.array().cast(f"array<struct<at:int,out:array<{kind}>>>"), chunk)


def _results(folded: Column) -> Column:
    return F.flatten(F.transform(folded, lambda x: x["out"]))


_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's spans: what `split` leaves between the matches gives their places."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    sizes = F.arrays_zip(
        F.transform(F.split(text, ("(?i)" if rule.any_case else "") + rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("size"),
        F.transform(tested, lambda x: F.length(x)).alias("tested"),
    )
    none = F.array().cast(f"array<{_SPAN}>")

    def emit(at, x):
        start = at + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return end, F.when(x["size"].isNotNull() & (x["tested"] >= rule.least), span).otherwise(none)

    return F.when(F.size(found) > 0, _results(_folded(sizes, _SPAN, emit))).otherwise(none)


def candidates(texts: DataFrame, rules) -> DataFrame:
    """(key, rules): the rules whose trigram query the text with this key meets; rules without a query are left out."""
    spark = texts.sparkSession
    needs = []
    for i, rule in enumerate(rules):
        for c, options in enumerate(trigram_query(rule.pattern, rule.any_case)):
            for o, grams in enumerate(options):
                needs += [(i, c, o, g, rule.any_case, len(grams)) for g in sorted(grams)]
    names = sorted({(g, ci) for _, _, _, g, ci, _ in needs})
    held = F.array(*(F.when(F.contains(F.col("low") if ci else F.col("text"), F.lit(g)), F.lit(n)) for n, (g, ci) in enumerate(names)))
    postings = texts.withColumn("low", F.lower("text")).select("key", F.explode(F.array_compact(held)).alias("gram")).distinct()
    number = {x: n for n, x in enumerate(names)}
    terms = spark.createDataFrame([(i, c, o, number[g, ci], n) for i, c, o, g, ci, n in needs], "rule int, clause int, option int, gram int, needed int")
    met = postings.join(F.broadcast(terms), "gram").groupBy("key", "rule", "clause", "option", "needed").agg(F.count("*").alias("n")).where("n = needed")
    clauses = {i: len(trigram_query(r.pattern, r.any_case)) for i, r in enumerate(rules)}
    whole = F.create_map(*itertools.chain.from_iterable((F.lit(i), F.lit(n)) for i, n in clauses.items()))
    met = met.select("key", "rule", "clause").distinct().groupBy("key", "rule").agg(F.count("*").alias("n")).where(F.col("n") == whole[F.col("rule")])
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))


def scan_secrets(docs: DataFrame, base=BASE_RULES, more=MORE_RULES) -> DataFrame:
    """(doc_id, text, found): for each row the array of (start, kind, end) of its secrets, by start and then kind; kind numbers base + more.

    Places are code points, ends exclusive; matches are leftmost and do not overlap within a kind.  A null text counts as empty.
    Null and repeated doc_ids and repeated rows are scanned each on their own; an empty table gives no rows.  Other columns are dropped.
    """
    rules = (*base, *more)
    return _found(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rules).select("doc_id", "text", "found")


def _found(texts: DataFrame, rules) -> DataFrame:
    """The rows of `texts` (text is not null) with the column `found`."""
    hits = saved(candidates(texts.select(F.xxhash64("text").alias("key"), "text"), rules).select(F.col("key").alias(_KEY), F.col("rules").alias(_RULES)), "secret-candidates")
    rows = texts.withColumn(_KEY, F.xxhash64("text")).join(hits, _KEY, "left")
    none = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, i)
        if trigram_query(rule.pattern, rule.any_case):
            spans = F.when(F.coalesce(F.col(_RULES), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, spans).otherwise(none)
        parts.append(spans)
    return rows.withColumn("found", F.array_sort(F.concat(*parts))).drop(_KEY, _RULES)


def _without(text: Column, found: Column, mark: str) -> Column:
    """The text with `mark` in place of the spans (by start; overlapping ones by one): the stretches between them, cut from pieces of the text and joined once."""
    gap = "struct<a:int,b:int>"
    none = F.array().cast(f"array<{gap}>")

    def emit(at, x):
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(F.struct(at.alias("a"), x["start"].alias("b")))).otherwise(none)

    folded, size = _folded(found, gap, emit), F.length(text)
    last = F.struct(F.get(folded, F.size(folded) - 1)["at"].alias("a"), size.alias("b"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(size / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))
    parts = F.struct(F.concat(_results(folded), F.array(last)).alias("gaps"), pieces.alias("pieces"))

    def stretch(p, g):
        i, j = F.floor(g["a"] / PIECE).cast("int"), F.floor(g["b"] / PIECE).cast("int")
        head = F.substring(F.get(p, i), g["a"] % PIECE + 1, F.least(g["b"] - g["a"], F.lit(PIECE)))
        between = F.when(j > i + 1, F.array_join(F.slice(p, i + 2, F.greatest(j - i - 1, F.lit(0))), "")).otherwise("")
        return F.when(i == j, head).otherwise(F.concat(head, between, F.substring(F.get(p, j), F.lit(1), g["b"] % PIECE)))

    return F.get(F.transform(F.array(parts), lambda x: F.array_join(F.transform(x["gaps"], lambda g: stretch(x["pieces"], g)), mark)), F.lit(0))


def redact_secrets(docs: DataFrame, base=BASE_RULES, more=MORE_RULES, mark: str = MARK) -> DataFrame:
    """The rows of `docs`, all columns as they are, but with each secret of the text replaced by `mark` (overlapping ones by one) and, where there is such a column, n_chars of a changed text anew.

    Null texts stay null.  A column named found is kept.
    """
    columns = docs.columns
    own = "__own_found"
    rows = docs.withColumnRenamed("found", own).withColumn("__null", F.col("text").isNull()).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = _found(rows, (*base, *more))
    text = F.col("text")
    clean = _without(text, F.col("found"), mark)
    new = F.when(F.size("found") > 0, clean).otherwise(text)
    out = []
    for c in columns:
        if c == "text":
            out.append(F.when(F.col("__null"), F.lit(None)).otherwise(new).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.size("found") > 0, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(own if c == "found" else f"`{c}`").alias(c))
    return rows.select(*out)


def _line(spans: Column, rules) -> Column:
    kind = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind[x["kind"]], x["start"], x["end"])), ",")


def _is(order: int):
    return lambda x: x["kind"] == order


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the scan of all documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("found", _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    base = F.filter("found", lambda x: x["kind"] < len(BASE_RULES))
    return found.select("doc_id", *counts, F.sha2(_line(base, BASE_RULES), 256).alias("base_sha256"), _line(F.col("found"), (*BASE_RULES, *MORE_RULES)).alias("spans"))


def _sql_rule(order: int, rule: Rule) -> str:
    pattern = (("(?i)" if rule.any_case else "") + rule.pattern).replace("'", "''")
    return f"""SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
      string_split_regex(t, '{pattern}') AS s, {rule.least} AS least FROM d"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate((*BASE_RULES, *MORE_RULES)))}),
u AS (SELECT doc_id, k, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, s FROM r),
p AS (SELECT doc_id, k, kind, length(g[i]) >= least AS ok, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM u),
f AS (SELECT doc_id, k, kind, a::BIGINT AS a, (a + n)::BIGINT AS b FROM p WHERE ok),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""
