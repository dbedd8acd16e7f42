"""Benchmark decontamination: word pairs find passages, Smith-Waterman alignment scores them.

Words are compared with A-Z lower-cased.  A text that shares enough word pairs with a test item, close together, is aligned with it, and its score is the best local
alignment's over that of the whole item with itself.  No pair is dropped for being frequent: how many others hold a passage has no say in whether a text is aligned.

The filter is exact.  Let an alignment of an item of n words match m of them, at a score of at least t = threshold; of its m - 1 steps from match to match z replace or
leave out words of the item, others add words to the text.  A step that adds none, or one, starts with a pair of the item, read with a gap of at most one word in the text.
From m + z <= n, and 2 m - (edits) >= 2 t n, at least n (4 t - 1) / 3 - 1 steps are of that kind (n / 3 - 1 at 0.5), and the text's side is at most n (3 - 2 t) words long.
So whatever holds fewer pairs within such a stretch can't reach the threshold; all else is aligned.

Items go in blocks of bounded words that are sent to all tasks, as many blocks as there are; texts stay where they lie and only hits are returned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import saved, sliced, table

#: Words of test items sent to the tasks at a time.
ITEM_WORDS = 1 << 20
#: Least score of a contaminated text, and of one where the item has fewer than SHORT words.
THRESHOLD = 0.5
SHORT = 8
#: Words of texts looked up at a time, beside the longest stretch that an alignment takes.
PIECE = 1 << 14
MATCH, MISMATCH, GAP = 2, -1, 1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the end of its text side (exclusive)."""
    steps = GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(text == w, MATCH, MISMATCH), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps  # gaps in the item's side
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


class Items:
    """Word pairs of a block of items: sorted (hash, item), and for each item how many of them a text must hold within how many words."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float):
        self.ids = ids
        words, first = W.words_of(pa.array(texts, pa.large_string()), True)
        self.words = [words[first[i] : first[i + 1]] for i in range(len(ids))]
        size = np.diff(first)
        self.least = np.where(size < SHORT, 1.0, threshold)
        self.need = np.maximum(np.ceil(size * (4 * self.least - 1) / 3 - 1 - 1e-9), 1).astype(np.int64)
        self.reach = np.ceil(size * (3 - 2 * self.least) + 1e-9).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), size)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        single = first[:-1][size == 1]
        seeds = np.zeros(len(inside) + len(single), [("hash", np.uint64), ("item", np.int64)])
        seeds["hash"] = np.concatenate((_pairs(words[inside], words[inside + 1]), W.mix(words[single])))
        seeds["item"] = np.concatenate((owner[inside], owner[single]))
        self.seeds = np.unique(seeds)
        self.single = bool(len(single))
        self.hashes, self.first = np.unique(self.seeds["hash"], return_index=True)
        self.count = np.diff(np.append(self.first, len(self.seeds)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def _hits(self, words: np.ndarray, text: np.ndarray):
        """(place, item) of each pair of an item in the words, read without a gap or with one of a word, inside a text; ordered by place."""
        found = [(np.arange(len(words)), W.mix(words))] if self.single else []
        for step in (1, 2):
            where = np.flatnonzero(text[step:] == text[:-step])
            found.append((where, _pairs(words[where], words[where + step])))
        places, items = [], []
        for where, h in found:
            kept = self.bits[(h >> np.uint64(44)).astype(np.int64)]
            where, h = where[kept], h[kept]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[at] == h
            where, at = where[same], at[same]
            count = self.count[at]
            own = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[at], count)
            places.append(np.repeat(where, count))
            items.append(self.seeds["item"][own])
        return np.concatenate(places), np.concatenate(items)

    def stretches(self, words: np.ndarray, first: np.ndarray):
        """(text, item, from, to) of the stretches of words that hold enough pairs of an item; every alignment that reaches the threshold lies inside one."""
        if not len(self.seeds):
            return
        longest = int(self.reach.max()) + 2
        step = max(PIECE, 2 * longest)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for begin in range(0, len(words), step):
            piece = slice(begin, begin + step + longest)
            text = owner[piece]
            place, item = self._hits(words[piece], text)
            order = np.lexsort((place, item, text[place]))
            place, item = place[order], item[order]
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1])
            place, item = place[new], item[new]
            last = np.arange(len(place)) + self.need[item] - 1
            at = np.flatnonzero(last < len(place))
            last = last[at]
            reach = self.reach[item[at]]
            near = (item[last] == item[at]) & (text[place[last]] == text[place[at]]) & (place[last] - place[at] <= reach)
            at, last, reach = at[near], last[near], reach[near]
            t = text[place[at]]
            a = np.maximum(place[last] + begin + 1 - reach, first[t])
            b = np.minimum(place[at] + begin + reach, first[t + 1])
            yield from zip(t.tolist(), item[at].tolist(), a.tolist(), b.tolist(), strict=True)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def passages(items: Items, words: np.ndarray, first: np.ndarray):
    """(text, item, score, first word, end word) of the best alignment of every text with every item that may reach its threshold there; words count from the text's start."""
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, i, a, b in items.stretches(words, first):
        spans.setdefault((t, i), []).append((a, b))
    for (t, i), found in spans.items():
        found.sort()
        merged = [list(found[0])]
        for a, b in found[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        n = len(items.words[i])
        score, a, end = max(_best(items.words[i], words, a, b) for a, b in merged)
        yield t, i, score / (MATCH * n), a - int(first[t]), end - int(first[t])


def _best(item: np.ndarray, words: np.ndarray, a: int, b: int) -> tuple[int, int, int]:
    score, end = align(item, words[a:b])
    return score, max(a, a + end - len(item)), a + end


def _hit_rows(batches, items: Items):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    for batch in sliced(batches, "text"):
        words, first = W.words_of(batch.column(1), True)
        rows = []
        for t, i, score, a, b in passages(items, words, first):
            if score >= items.least[i]:
                rows.append((batch.column(0)[t].as_py(), items.ids[i], score, a, b))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)


def _item_blocks(benchmark: DataFrame, limit: int):
    ids, texts, words = [], [], 0
    for row in benchmark.toLocalIterator(prefetchPartitions=False):
        ids.append(row["item_id"])
        texts.append(row["text"] or "")
        words += len(texts[-1].split())
        if words >= limit:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def _clean_rows(batches, items: Items):
    for batch in sliced(batches, "text"):
        words, first = W.words_of(batch.column(batch.schema.get_field_index("text")), True)
        clean = np.ones(batch.num_rows, bool)
        for t, i, score, _, _ in passages(items, words, first):
            clean[t] &= score < items.least[i]
        yield batch.filter(pa.array(clean))


def _blocks(benchmark: DataFrame, threshold: float, limit: int):
    for ids, texts in _item_blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), limit):
        items = Items(ids, texts, threshold)
        if len(items.seeds):
            yield items


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): every row of `docs` and item of `benchmark` whose best alignment reaches the threshold.

    The span is where the passage lies, in words of the text.  Null, empty and blank texts and items match nothing; items of fewer than SHORT words must be
    held whole.  At thresholds below 0.5 the copies of short items may share no pair with them, so rows can be missed.
    Null and repeated ids stay as they are.  No items, no texts or no hits give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    for items in _blocks(benchmark, threshold, limit):
        part = rows.mapInArrow(functools.partial(_hit_rows, items=items), out.schema)
        out = out.unionByName(saved(part, "contaminated"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = ITEM_WORDS) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `contamination` doesn't report."""
    out = docs
    for items in _blocks(benchmark, threshold, limit):
        out = out.mapInArrow(functools.partial(_clean_rows, items=items), docs.schema)
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
