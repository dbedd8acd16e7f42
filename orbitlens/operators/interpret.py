"""From questions to plans: a DataFrame of texts in, one row of plan fields a text out, all as column expressions."""

from __future__ import annotations

import datetime as dt
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    ANY_YEAR, ARCHIVE_START, CHANGE_CUES, DECADE_BACK, DOWN_VERBS, FALLS, MODES, NEAR_FEATURES, NEAR_WORDS, PHRASES, PLACE_NOISE, PLACE_TOKEN, PLACE_WORDS, REWRITES, RISES, SIMILARITY_CUES,
    SMALL_PLACE_WORDS, STOPWORDS, SUBJECTS, UP_VERBS, YEAR_BACK, YEAR_SINCE, YEAR_SPAN, YEARS_BACK,
)

#: Longest first; equal lengths in the order of the modes' lists.
ORDERED = sorted(((p, m) for m, ps in PHRASES.items() for p in ps), key=lambda x: -len(x[0]))
_FAR = 10**6


def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalise(text: Column, compatible: bool = False) -> Column:
    """Dashes and quotes as ASCII, white space collapsed; with `compatible` letters of other widths and forms as plain ones first (by way of Python)."""
    text = F.pandas_udf(_compatible, T.StringType())(text) if compatible else text
    return F.trim(F.regexp_replace(F.translate(text, "–—‘’", "--''"), r"(?U)\s+", " "))


def phrase_hits(q: Column) -> Column:
    """Array of (p, m, i): each phrase, its mode and number, that is in the text after those before it were taken out.

    Taking a phrase out leaves a space, so whatever appears later has its words in the text from the start: only such phrases are tried, one after the other.
    """
    words = lambda p: F.array(*(F.lit(w) for w in p.split()))
    table = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(m).alias("m"), F.lit(i).alias("i"), words(p).alias("w")) for i, (p, m) in enumerate(ORDERED)))
    likely = F.transform(F.filter(table, lambda x: F.forall(x["w"], lambda w: F.contains(q, w))), lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), x["i"].alias("i")))
    none = F.array().cast("array<struct<p:string,m:string,i:int>>")
    start = F.struct(q.alias("left"), none.alias("hits"))

    def take(acc, x):
        found = F.contains(acc["left"], x["p"])
        return F.when(found, F.struct(F.replace(acc["left"], x["p"], F.lit(" ")).alias("left"), F.concat(acc["hits"], F.array(x)).alias("hits"))).otherwise(acc)

    return F.aggregate(likely, start, take, lambda acc: acc["hits"])


def _mode_scores(hits: Column) -> Column:
    """Best (score, -first hit, mode) by total length of a mode's phrases."""
    scores = []
    for m in MODES:
        own = F.filter(hits, _of(m))
        scores.append(F.struct(F.aggregate(own, F.lit(0), lambda a, x: a + F.length(x["p"])).alias("score"), (-F.coalesce(F.array_min(F.transform(own, lambda x: x["i"])), F.lit(_FAR))).alias("first"), F.lit(m).alias("mode")))
    return F.array_max(F.array(*scores))


def _of(mode: str):
    return lambda x: x["m"] == mode


def _first_place(q: Column, words) -> Column:
    return F.array_min(F.array(*(F.when(F.contains(q, F.lit(w)), F.instr(q, F.lit(w))).otherwise(F.lit(_FAR)) for w in words)))


def _any(q: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(q, F.lit(w)) for w in words))


def subject_mode(q: Column) -> Column:
    """Struct (mode, noun) from a subject and the direction that is named first; null without."""
    subject = reduce(lambda a, k: a.when(_any(q, SUBJECTS[k]), F.lit(k)), SUBJECTS, F.when(F.lit(False), F.lit("")))
    noun = F.coalesce(*(F.when(F.contains(q, F.lit(n)) & (subject == k), F.lit(n)) for k, ns in SUBJECTS.items() for n in ns))
    down, up = _first_place(q, DOWN_VERBS), _first_place(q, UP_VERBS)
    stated = F.least(down, up) < _FAR
    falls = down < up
    mode = (
        F.when(subject == "urban", "urban_expansion")
        .when(stated & (subject == "water"), F.when(falls, "water_loss").otherwise("water_gain"))
        .when(stated & (subject == "vegetation"), F.when(falls, "vegetation_loss").otherwise("vegetation_gain"))
    )
    return F.struct(mode.alias("mode"), noun.alias("noun"))


def years(q: Column, today: dt.date) -> Column:
    """Struct (start, end, stated): the observation window by the first rule that fits, held to the archive."""
    now = today.year
    pick = lambda pattern, group: F.nullif(F.regexp_extract(q, pattern, group), F.lit("")).cast("int")
    a, b = pick(YEAR_SPAN, 1), pick(YEAR_SPAN, 2)
    back = pick(YEARS_BACK, 1)
    since = pick(YEAR_SINCE, 1)
    loose = F.filter(F.transform(F.regexp_extract_all(q, F.lit(f"(?U){ANY_YEAR}"), F.lit(1)), lambda x: x.cast("int")), lambda x: (x >= ARCHIVE_START - 1) & (x <= now + 1))
    one = F.element_at(loose, 1)
    pair = lambda x, y, stated=True: F.struct(x.cast("int").alias("start"), y.cast("int").alias("end"), F.lit(stated).alias("stated"))
    window = (
        F.when(a.isNotNull(), pair(F.least(a, b), F.greatest(a, b)))
        .when(back.isNotNull(), pair(F.lit(now) - F.greatest(F.lit(1), back), F.lit(now)))
        .when(F.rlike(q, F.lit(DECADE_BACK)), pair(F.lit(now - 10), F.lit(now)))
        .when(F.rlike(q, F.lit(YEAR_BACK)), pair(F.lit(now - 1), F.lit(now)))
        .when(since.isNotNull(), pair(since, F.lit(now)))
        .when(F.size(loose) >= 2, pair(F.array_min(loose), F.array_max(loose)))
        .when((F.size(loose) == 1) & (one >= now), pair(F.greatest(F.lit(ARCHIVE_START), one - 2), F.lit(now)))
        .when(F.size(loose) == 1, pair(one, F.lit(now)))
        .otherwise(pair(F.lit(now - 4), F.lit(now), False))
    )
    return held(window["start"], window["end"], window["stated"], today)


def held(start: Column, end: Column, stated: Column, today: dt.date) -> Column:
    """Struct (start, end, stated, asked): the window inside the archive's years; asked is the start before that."""
    first = F.greatest(start, F.lit(ARCHIVE_START))
    last = F.least(end, F.lit(today.year))
    return F.struct(first.alias("start"), F.when(last <= first, F.least(F.lit(today.year), first + 1)).otherwise(last).alias("end"), stated.alias("stated"), start.alias("asked"))


def proximity(q: Column) -> Column:
    near = F.rlike(q, F.lit(rf"(?U)\b(?:{'|'.join(NEAR_WORDS)})\b"))
    out = reduce(lambda a, k: a.when(near & F.rlike(q, F.lit(rf"(?U)\b(?:{'|'.join(NEAR_FEATURES[k])})\b")), F.lit(k)), NEAR_FEATURES, F.when(F.lit(False), F.lit("")))
    return out


def _clean_place(text: Column) -> Column:
    """The words without stop words at either end and outer punctuation; null below three characters."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    telling = F.transform(words, lambda w: ~F.lower(w).isin(*STOPWORDS))
    first, last = F.array_position(telling, True), F.size(words) - F.array_position(F.reverse(telling), True) + 1
    out = F.regexp_replace(F.concat_ws(" ", F.slice(words, first.cast("int"), (last - first + 1).cast("int"))), r"^[ ,.;:!?]+|[ ,.;:!?]+$", "")
    return F.when(F.when(first > 0, F.length(out) >= 3), out)


def place(text: Column) -> Column:
    """Name of the place a (normalised) question is about, or null.

    A chain of capitalised names after a locative word, else the longest run of capitalised words, else the small words after a locative word.
    """
    bare = reduce(lambda t, pattern: F.regexp_replace(t, f"(?U){pattern}", " "), PLACE_NOISE, text)
    names = rf"{PLACE_TOKEN}(?:\s+{PLACE_TOKEN}){{0,3}}"
    chain = F.regexp_extract(bare, rf"(?U)\b{PLACE_WORDS}\s+({names}(?:\s*,\s*{names}){{0,4}})", 1)
    small = F.regexp_extract(bare, rf"(?U)\b{SMALL_PLACE_WORDS}\s+([a-z][\w'\-]*(?:\s+[a-z][\w'\-]*){{0,2}})", 1)
    words = F.transform(F.split(F.trim(bare), r"\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\w'\-]", ""))
    none = F.array().cast("array<string>")

    def step(acc, w):
        run = F.when(F.rlike(w, F.lit(r"^\p{Lu}")) & ~F.lower(w).isin(*STOPWORDS), F.concat(acc["run"], F.array(w))).otherwise(none)
        return F.struct(F.when(F.size(run) > F.size(acc["best"]), run).otherwise(acc["best"]).alias("best"), run.alias("run"))

    longest = F.aggregate(words, F.struct(none.alias("best"), none.alias("run")), step, lambda acc: F.concat_ws(" ", acc["best"]))
    return F.coalesce(_clean_place(chain), _clean_place(longest), _clean_place(small))


def interpret(questions: DataFrame, today: dt.date, text: str = "text", place_override: str | None = None, years_override: tuple[int, int] | None = None, compatible: bool = False) -> DataFrame:
    """`questions` with place, mode, label, index, direction, start_year, end_year, proximity, wants_similarity, matched, confidence, reasoning and assumptions.

    The place is a name, which `places.look_up` or a geocoder turns into a box.  Overrides replace what the text says of place and years (both of them); they are
    held to the archive and raise the confidence just the same.  Null texts count as empty and get the default plan.
    """
    plain = normalise(F.coalesce(F.col(text), F.lit("")), compatible)
    rows = questions.withColumn("plain", plain)
    given = F.lit(place_override.strip()) if place_override else None
    rows = rows.withColumns({"place": place(F.col("plain")) if given is None else given, "q": F.lower("plain")})
    rows = rows.withColumn("hits", phrase_hits(F.col("q"))).withColumn("best", _mode_scores(F.col("hits"))).withColumn("subject", subject_mode(F.col("q")))
    phrase_mode = F.when(F.size("hits") > 0, F.col("best.mode"))
    own = F.transform(F.filter("hits", lambda x: x["m"] == F.col("best.mode")), lambda x: x["p"])
    rows = rows.withColumns({"phrase_mode": phrase_mode, "own": own})
    generic = (F.size("own") > 0) & F.forall("own", lambda x: F.length(x) <= 6)
    refined = (F.col("phrase_mode").isNull() | generic) & F.col("subject.mode").isNotNull() & ~F.col("subject.mode").eqNullSafe(F.col("phrase_mode"))
    rows = rows.withColumns({"refined": refined, "found": F.when(refined, F.col("subject.mode")).otherwise(F.col("phrase_mode"))})
    matched = F.when(F.col("refined"), F.concat(F.when(generic, F.col("own")).otherwise(F.array().cast("array<string>")), F.array("subject.noun"))).otherwise(F.col("own"))
    mode = F.coalesce("found", F.lit("urban_expansion"))
    green = mode.isin("vegetation_loss", "vegetation_gain")
    rises, falls = F.rlike("q", F.lit(f"(?U){RISES}")), F.rlike("q", F.lit(f"(?U){FALLS}"))
    window = years(F.col("q"), today) if years_override is None else held(F.lit(years_override[0]), F.lit(years_override[1]), F.lit(True), today)
    rows = rows.withColumns({"matched": matched, "mode": F.when(green & rises, "vegetation_gain").when(green & falls, "vegetation_loss").otherwise(mode), "window": window, "cued": _any(F.col("q"), CHANGE_CUES)})
    labels = F.create_map(*(x for m, v in MODES.items() for x in (F.lit(m), F.struct(*(F.lit(y).alias(n) for n, y in zip(("label", "index", "direction"), v, strict=True))))))
    spec = labels[F.col("mode")]
    confidence = F.lit(0.35) + F.when(F.col("found").isNotNull(), 0.30).otherwise(0.0) + F.when(F.col("cued"), 0.10).otherwise(0.0) + F.when(F.col("place").isNotNull(), 0.20).otherwise(0.0) + F.when(F.col("window.stated"), 0.10).otherwise(0.0)
    rows = rows.withColumns({
        "label": spec["label"], "index": spec["index"], "direction": spec["direction"], "start_year": F.col("window.start"), "end_year": F.col("window.end"), "proximity": proximity(F.col("q")),
        "wants_similarity": _any(F.col("q"), SIMILARITY_CUES), "confidence": F.round(F.least(confidence, F.lit(0.98)), 2),
    })
    reasoning = (
        F.when(F.col("refined"), "The subject and the verb of the question decide the analysis."),
        F.when(F.col("found").isNotNull(), F.concat(F.lit("Matched "), F.concat_ws(", ", F.slice("matched", 1, 3)), F.lit(": "), "label", F.lit(" by "), "index", F.lit("."))),
        F.when(F.col("cued"), "The question compares dates."),
        F.when(F.col("place").isNotNull(), F.concat(F.lit("Place: "), "place", F.lit("." if given is None else ", as given."))),
        F.when(F.col("window.stated"), F.format_string("Years: %d to %d" + ("." if years_override is None else ", as given."), "start_year", "end_year")),
        F.when(F.col("proximity").isNotNull(), F.concat(F.lit("It is about ground near "), "proximity", F.lit("."))),
        F.when(F.col("wants_similarity"), "Similar places are asked for."),
    )
    assumptions = (
        F.when(F.col("found").isNull(), "No known kind of change was named, so built-up land is analysed."),
        F.when(~F.col("cued"), "No comparison was asked for; dates are compared all the same."),
        F.when(F.col("place").isNull(), "No place was found."),
        F.when(~F.col("window.stated"), F.format_string("No years were named, so %d to %d are taken.", "start_year", "end_year")),
        F.when(F.col("window.asked") < ARCHIVE_START, F.format_string(f"The archive begins in {ARCHIVE_START}, not %d.", "window.asked")),
    )
    rows = rows.withColumns({"reasoning": F.array_compact(F.array(*reasoning)), "assumptions": F.array_compact(F.array(*assumptions))})
    return rows.drop("plain", "q", "hits", "best", "subject", "phrase_mode", "own", "refined", "found", "window", "cued")


def sanitise(text: Column) -> Column:
    """Accusing words replaced by careful ones."""
    return reduce(lambda t, r: F.regexp_replace(t, f"(?i){r[0]}", r[1]), REWRITES, text)
