"""Substring dedup: a compacted de Bruijn graph over sampled word k-mers finds long repeated spans.

Words stay as they are.  Of every WINDOW consecutive words, the K-mer with the least hash is an anchor, so that equal windows have equal anchors at equal
places.  Anchors that several documents hold are the graph's nodes, and consecutive anchors of a document (with their distance, at most K, so that
both fix all words between) its edges.  An edge that every occurrence of both its ends goes along can't branch; such paths are compacted by pointer jumping in Spark joins.
All occurrences of a compacted path are whole, so every window inside it lies in the same documents and the least doc_id of one node decides for all.
Windows that a path doesn't cover are compared one by one at their source coordinates, by the hash of all their words.

Texts travel in packed blocks, never twice to find the graph: the first pass leaves only anchors (about 2 in 26 words).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import blocks_of, discard, saved, scratch, table

WINDOW = 50
#: Bytes of text to a block.
BLOCK = 4 << 20
#: Stands for a null doc_id: never smaller than another.
NO_ID = 2**63 - 1

_PACKED = "block long, texts binary, sizes binary, ids binary, known binary, row int, doc_id long, nth int, pos int, anchor long"


def kmer_size(window: int) -> int:
    """K: a window holds window - K + 1 K-mers, and consecutive anchors lie no farther apart than that, at most K."""
    return window // 2 + 1


def minimizers(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within a text, the anchor's place of each, the K-mer hashes, and the text of each window."""
    k = kmer_size(window)
    count = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    starts = np.arange(len(text)) + np.repeat(first[:-1] - np.cumsum(count) + count, count)
    hashes = W.window_hashes(words, k)
    place = np.empty(len(starts), np.int64)
    span = np.arange(window - k + 1)
    for at in range(0, len(starts), 1 << 15):
        s = starts[at : at + (1 << 15)]
        place[at : at + len(s)] = s + hashes[s[:, None] + span].argmin(1)
    return starts, place, hashes, text


def _ranges(data: np.ndarray, offsets: np.ndarray):
    """Ranges of whole texts with their word hashes and bounds."""
    starts, ends, first = W.word_bounds(data, offsets)
    for a, b in W.slices(first, 1 << 18):
        yield a, b, W.hash_words(data, starts[first[a] : first[b]], ends[first[a] : first[b]], False), first[a : b + 1] - first[a]


_PACKED_ARROW = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("known", pa.binary()), ("row", pa.int32()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("pos", pa.int32()), ("anchor", pa.int64())])


def _pack(batches, window: int):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for kept in blocks_of(batches, ("doc_id", "text"), "text", BLOCK):
        rows = pa.Table.from_batches(kept)
        data, offsets = W.text_buffer(rows["text"])
        known = ~np.asarray(rows["doc_id"].is_null())
        ids = np.asarray(rows["doc_id"].fill_null(NO_ID), np.int64)
        values = {"block": [block], "texts": [pa.compress(data.tobytes(), "zstd", asbytes=True)], "sizes": [offsets.tobytes()], "ids": [ids.tobytes()], "known": [known.tobytes()]}
        yield pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None]), f.type) for f in _PACKED_ARROW], schema=_PACKED_ARROW)
        for a, _, words, first in _ranges(data, offsets):
            _, place, hashes, text = minimizers(words, first, window)
            if not len(place):
                continue
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
            place, text = place[new], text[new]
            begin = np.searchsorted(text, text)
            none = pa.nulls(len(place), pa.binary())
            columns = [pa.array(np.full(len(place), block)), none, none, none, none, pa.array((text + a).astype(np.int32)), pa.array(ids[text + a]), pa.array((np.arange(len(text)) - begin).astype(np.int32)), pa.array((place - first[text]).astype(np.int32)), pa.array(hashes[place].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=_PACKED_ARROW)
        block += 1


def _unpack(rows: pa.Table):
    """Bytes, offsets, ids (NO_ID for null) of a block, and its other rows."""
    is_text = np.asarray(rows["texts"].is_valid())
    own = rows.filter(pa.array(is_text)).select(["texts", "sizes", "ids", "known"]).to_pylist()[0]
    offsets = np.frombuffer(own["sizes"], np.int64)
    data = np.frombuffer(pa.decompress(own["texts"], int(offsets[-1]), "zstd", asbytes=True), np.uint8)
    return data, offsets, np.frombuffer(own["ids"], np.int64), np.frombuffer(own["known"], bool), rows.filter(pa.array(~is_text))


def _open_windows(window: int):
    """Windows whose anchor is a node and that the node's path doesn't cover, with the hash of all their words."""

    def of(key, rows):
        data, offsets, ids, _, nodes = _unpack(rows)
        row, pos, start, size = (np.asarray(nodes[c], np.int64) for c in ("row", "pos", "path_start", "path_words"))
        place = (row << 32) | pos
        order = np.argsort(place)
        place, start, end = place[order], start[order], (start + size)[order]
        out = []
        for a, _, words, first in _ranges(data, offsets):
            starts, anchor, _, text = minimizers(words, first, window)
            if not len(starts) or not len(place):
                continue
            own = ((text + a) << 32) | (anchor - first[text])
            at = np.minimum(np.searchsorted(place, own), len(place) - 1)
            begin = starts - first[text]
            kept = (place[at] == own) & ((begin < start[at]) | (begin + window > end[at]))
            if kept.any():
                hashes = W.window_hashes(words, window)[starts[kept]]
                out.append((text[kept] + a, begin[kept], hashes, ids[text[kept] + a]))
        row, begin, hashes, doc = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
        return pa.table({"block": pa.array(np.full(len(row), key[0].as_py(), np.int64)), "row": pa.array(row.astype(np.int32)), "start": pa.array(begin.astype(np.int32)), "hash": pa.array(hashes.view(np.int64)), "doc_id": pa.array(doc)})

    return of


def _keep(key, rows):
    """Per text: what remains without the words of the spans."""
    data, offsets, ids, known, spans = _unpack(rows)
    row, start, size = (np.asarray(spans[c], np.int64) for c in ("row", "start", "words"))
    order = np.argsort(row, kind="stable")
    row, start, size = row[order], start[order], size[order]
    bounds = np.searchsorted(row, np.arange(len(ids) + 1))
    words_out, removed_out, kept_out = [], [], []
    whole = data.tobytes()
    for i in range(len(ids)):
        words = whole[offsets[i] : offsets[i + 1]].split()
        removed = 0
        n = len(words)
        if bounds[i] < bounds[i + 1]:
            delta = np.zeros(n + 1, np.int64)
            np.add.at(delta, start[bounds[i] : bounds[i + 1]], 1)
            np.add.at(delta, (start + size)[bounds[i] : bounds[i + 1]], -1)
            kept = np.cumsum(delta[:-1]) == 0
            removed = n - int(kept.sum())
            words = [words[j] for j in np.flatnonzero(kept)]
        words_out.append(n)
        removed_out.append(removed)
        kept_out.append(b" ".join(words))
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~known), "n_words": pa.array(words_out, pa.int64()), "n_removed": pa.array(removed_out, pa.int64()), "kept": pa.array(kept_out, pa.binary())})


def _digest(key, rows):
    out = _keep(key, rows)
    return out.set_column(3, "kept_sha256", pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in out["kept"]], pa.string()))


def _paths(edges: DataFrame) -> DataFrame:
    """(node, head, words_before): for each node that ends an unbranched edge (a, b, gap), its path's first node and the distance to it."""
    state = saved(edges.select(F.col("b").alias("node"), F.col("a").alias("head"), F.col("gap").cast("long").alias("words_before")), "paths")
    while True:
        other = state.select(F.col("node").alias("head"), F.col("head").alias("farther"), F.col("words_before").alias("more"))
        words = (F.col("words_before") + F.coalesce("more", F.lit(0))).alias("words_before")
        jumped = saved(state.join(other, "head", "left").select("node", F.coalesce("farther", "head").alias("head"), words, F.col("farther").isNotNull().alias("moved")), "paths")
        discard(state)
        state = jumped
        if state.where("moved").limit(1).count() == 0:
            return state.drop("moved")


def _with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    for c, kind in texts.dtypes:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    for c, kind in rows.dtypes:
        if c not in texts.columns:
            texts = texts.withColumn(c, F.lit(None).cast(kind))
    return texts.unionByName(rows)


def _dedup(docs: DataFrame, window: int, finish, schema: str) -> DataFrame:
    with scratch() as own:
        texts, spans = _spans(docs, window, own)
        spans = own.keep(saved(spans, "substring-spans"))
    return _with_texts(texts, spans).groupBy("block").applyInArrow(finish, schema)


def _spans(docs: DataFrame, window: int, own) -> tuple[DataFrame, DataFrame]:
    """The packed texts, and (block, row, start, words) of the spans whose words go; what the spans are made from goes with the scope `own`."""
    k = kmer_size(window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = own.keep(saved(rows.mapInArrow(functools.partial(_pack, window=window), _PACKED), "substring-packed"))
    texts = packed.where("texts is not null").select("block", "texts", "sizes", "ids", "known")
    anchors = packed.where("anchor is not null").select("block", "row", "doc_id", "nth", "pos", "anchor")
    # aggregates are written before they are joined, so that Spark can split a hot key's rows over tasks
    shared = saved(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").drop("most"), "substring-shared")
    nodes = saved(anchors.join(shared, "anchor"), "substring-nodes")
    along = Window.partitionBy("block", "row").orderBy("nth")
    step = nodes.select("anchor", "n", "nth", "pos", *(F.lead(c).over(along).alias(f"next_{c}") for c in ("anchor", "n", "nth", "pos"))).where("next_nth = nth + 1")
    edges = step.groupBy(F.col("anchor").alias("a"), F.col("next_anchor").alias("b"), (F.col("next_pos") - F.col("pos")).alias("gap")).agg(F.count("*").alias("c"), F.min("n").alias("na"), F.min("next_n").alias("nb"))
    paths = _paths(edges.where("c = na and c = nb"))
    length = paths.groupBy(F.col("head").alias("anchor")).agg((F.max("words_before") + k).alias("words"))
    on_path = paths.select(F.col("node").alias("anchor"), "head", "words_before").unionByName(length.select("anchor", F.col("anchor").alias("head"), F.lit(0).cast("long").alias("words_before")))
    on_path = on_path.join(length.select(F.col("anchor").alias("head"), "words"), "head").drop("head")
    placed = nodes.join(on_path, "anchor", "left").select("block", "row", "doc_id", "pos", "least", (F.col("pos") - F.coalesce("words_before", F.lit(0))).alias("path_start"), F.coalesce("words", F.lit(k)).alias("path_words"))
    placed = saved(placed, "substring-placed")
    windows = _with_texts(texts, placed.select("block", "row", "pos", "path_start", "path_words")).groupBy("block")
    windows = saved(windows.applyInArrow(_open_windows(window), "block long, row int, start int, hash long, doc_id long"), "substring-windows")
    least = saved(windows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").drop("most"), "substring-least")
    spans = windows.join(least, "hash").where("least < doc_id").select("block", "row", F.col("start").cast("long").alias("start"), F.lit(window).cast("long").alias("words"))
    whole = placed.where((F.col("path_start") == F.col("pos")) & (F.col("path_words") >= window) & (F.col("least") < F.col("doc_id"))).select("block", "row", F.col("path_start").cast("long").alias("start"), F.col("path_words").cast("long").alias("words"))
    return texts, spans.unionByName(whole)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of `docs` (doc_id, text) without the words that a window covers which also starts in a document with a smaller doc_id.

    `kept` holds the remaining words, one space between, as UTF-8.  Null texts have no words.  A null doc_id is larger than any other; rows with equal doc_id are
    no smaller than each other, so they do not remove each other's words.  A window that repeats only within its document stays.  An empty table gives no rows.
    """
    return _dedup(docs, window, _keep, "doc_id long, n_words long, n_removed long, kept binary")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return _dedup(table(spark, sf_dir, "documents"), WINDOW, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM g),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
b AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM h JOIN m USING (h) WHERE least < doc_id),
r AS (SELECT doc_id, list(j) AS js FROM b GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(js, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
