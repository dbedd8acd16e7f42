"""LM scoring by context-tree weighting.

Bytes (A-Z lower-cased) are split into eight binary decisions.  Each context of 0 to `depth` preceding bytes holds
Krichevsky-Trofimov counts for its decisions; every node weighs its own estimate against the product of its
extensions' (Willems, Shtarkov and Tjalkens, 1995), learned from the training texts, and a text's score is the log10
probability that the weighted tree gives it, its end included.

The tree is never on one machine.  Texts are packed into blocks; each block hands over its distinct byte grams
(context and symbol) with their training counts, dealt by the two latest context bytes, so that a part holds whole
subtrees from depth 2 on.  Blocks are merged in a tree of bounded fan-in.  The two uppermost levels (at most 256 * 255 + 255
nodes) are summed apart and sent to all tasks.  Parts answer each block with the log probabilities of its own grams.  The unigram
base score goes the same way with word hashes in place of grams.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import blocks_of, partitions, remainder, saved, table

#: Preceding bytes in the longest context; at most 5, so that a gram fits 48 bits.
DEPTH = 5
#: Bytes of text to a block.
BLOCK = 16 << 20
#: Blocks that one merge reads.
FAN_IN = 64
_FF = np.uint8(255)
_END = W.mix(np.array([0xE0D], np.uint64))[0]
_ZERO = 1 << 16
_LGAMMA: list[np.ndarray] = []


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, lifted by eight steps for small x > 0."""
    small = x < 8
    y = np.where(small, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    if small.any():
        z = x[small]
        product = z.copy()
        for i in range(1, 8):
            product *= z + i
        out[small] -= np.log(product)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    if not _LGAMMA:
        n = np.arange(_ZERO, dtype=float)
        _LGAMMA.extend((_log_gamma(n + 0.5), _log_gamma(n + 1)))

    def at(kind: int, v: np.ndarray) -> np.ndarray:
        out = _LGAMMA[kind][np.minimum(v, _ZERO - 1).astype(np.int64)]
        large = v >= _ZERO
        if large.any():
            out[large] = _log_gamma(v[large] + (0.5, 1.0)[kind])
        return out

    return at(0, a) + at(0, b) - at(1, a + b) - 1.1447298858494002


class _Level:
    """Nodes of one context length: for each of the eight decisions, the node of each gram, counts and log probabilities."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.node, self.a, self.b, self.first = keys, [], [], [], []
        for j in range(8):
            group = keys >> np.uint64(8 - j)
            new = np.ones(len(keys), bool)
            new[1:] = group[1:] != group[:-1]
            first = np.flatnonzero(new)
            bit = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
            total = np.add.reduceat(n, first)
            ones = np.add.reduceat(np.where(bit, n, 0.0), first)
            self.node.append(np.cumsum(new) - 1)
            self.first.append(first)
            self.a.append(total - ones)
            self.b.append(ones)


def part_tree(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For sorted distinct grams with whole subtrees from context length `top` on (top >= 1): the probability of a one at each of the eight decisions
    as the subtrees at `top` see it, and the counts and log probabilities to add at context length top - 1 (node number, zeros, ones, log)."""
    levels, ups = [_Level(keys, n)], []
    for _ in range(depth - top):
        above, up = np.unique(((levels[-1].keys >> np.uint64(16)) << np.uint64(8)) | (levels[-1].keys & np.uint64(255)), return_inverse=True)
        ups.append(up)
        levels.append(_Level(above, np.bincount(up, levels_n(levels[-1], n, ups), len(above))))
    ones = np.empty((len(keys), 8))
    ids, zeros_out, ones_out, logs_out = [], [], [], []
    for j in range(8):
        log_w, weights = None, []
        for d, level in enumerate(levels):
            own = log_kt(level.a[j], level.b[j])
            if d:
                parent = level.node[j][ups[d - 1][levels[d - 1].first[j]]]
                below = np.bincount(parent, log_w, len(own))
                weights.append((parent, 1 / (1 + np.exp(np.clip(below - own, -700, 700)))))
                log_w = np.logaddexp(own, below) - np.log(2)
            else:
                log_w = own
        p = (levels[0].b[j] + 0.5) / (levels[0].a[j] + levels[0].b[j] + 1)
        where = np.arange(len(p))
        estimates = []
        for d, (parent, weight) in enumerate(weights):
            where = parent[where]
            level = levels[d + 1]
            estimates.append((where, weight, (level.b[j] + 0.5) / (level.a[j] + level.b[j] + 1)))
        for where, weight, kt in estimates:
            p = weight[where] * kt[where] + (1 - weight[where]) * p
        ones[:, j] = p[levels[0].node[j]]
        last = levels[-1]
        key = last.keys[last.first[j]]
        # the symbol's first j bits under a leading one number the node within its context
        prefix = ((key & np.uint64(255)) >> np.uint64(8 - j)) | np.uint64(1 << j)
        shorter = key >> np.uint64(16) << np.uint64(8)
        number, back = np.unique(shorter | prefix, return_inverse=True)
        ids.append(number)
        for out, v in ((zeros_out, last.a[j]), (ones_out, last.b[j]), (logs_out, log_w)):
            out.append(np.bincount(back, v, len(number)))
    return ones, tuple(np.concatenate(x) if x else np.zeros(0) for x in (ids, zeros_out, ones_out, logs_out))


def levels_n(level: _Level, n: np.ndarray, ups: list[np.ndarray]) -> np.ndarray:
    """Counts of the grams of a level: those of the longest grams, summed upwards."""
    for up in ups[:-1]:
        n = np.bincount(up, n, int(up.max()) + 1 if len(up) else 0)
    return n


def top_nodes(ids: np.ndarray, a: np.ndarray, b: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, ...]:
    """From the sums over context length 1 (node number: byte * 256 + decision): weight and estimate of each node there, and of the root's."""
    full = [np.zeros(1 << 16) for _ in range(3)]
    for out, v in zip(full, (a, b, logs), strict=True):
        out[ids] = v
    a, b, logs = full
    own = log_kt(a, b)
    w1 = 1 / (1 + np.exp(np.clip(logs - own, -700, 700)))
    k1 = (b + 0.5) / (a + b + 1)
    log_w = np.where((a + b) > 0, np.logaddexp(own, logs) - np.log(2), 0.0)
    a0, b0, l0 = (x.reshape(256, 256).sum(0) for x in (a, b, log_w))
    own = log_kt(a0, b0)
    return w1, k1, 1 / (1 + np.exp(np.clip(l0 - own, -700, 700))), (b0 + 0.5) / (a0 + b0 + 1)


def log10_probability(keys: np.ndarray, ones: np.ndarray, top: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    """log10 probability of each gram's symbol in its context."""
    w1, k1, w0, k0 = top
    symbol = (keys & np.uint64(255)).astype(np.int64)
    latest = ((keys >> np.uint64(8 * depth)) & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(keys))
    for j in range(8):
        node = (symbol >> (8 - j)) | (1 << j)
        deep = latest * 256 + node
        p = w0[node] * k0[node] + (1 - w0[node]) * (w1[deep] * k1[deep] + (1 - w1[deep]) * ones[:, j])
        bit = (symbol >> (7 - j)) & 1
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def _stream(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each after `depth` bytes of 255 (which UTF-8 never has) and before one, its end; and where each text starts."""
    n = len(offsets) - 1
    out = np.full(len(data) + (n + 1) * depth, _FF)
    starts = offsets[:-1] + depth * np.arange(1, n + 1)
    sizes = np.diff(offsets)
    out[np.arange(len(data)) + depth * np.repeat(np.arange(1, n + 1), sizes)] = W.LOWER[data]
    return out, starts


def _gram_chunks(data: np.ndarray, offsets: np.ndarray, depth: int, size: int = 1 << 20):
    """For ranges of whole texts: gram of every byte and end (context above, symbol below), and each text's first gram."""
    at = 0
    while at < len(offsets) - 1:
        stop = max(int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1, at + 1)
        own = offsets[at : stop + 1] - offsets[at]
        stream, starts = _stream(data[offsets[at] : offsets[stop]], own, depth)
        wide = np.concatenate((stream, np.zeros(8, np.uint8)))
        counts = np.diff(own) + 1
        first = np.concatenate(([0], np.cumsum(counts)))
        where = np.arange(first[-1]) + np.repeat(starts - first[:-1] - depth, counts)
        loads = np.ndarray((len(stream),), "<u8", wide, strides=(1,))[where]
        context = loads & np.uint64((1 << 8 * depth) - 1)
        yield at, stop, (context << np.uint64(8)) | ((loads >> np.uint64(8 * depth)) & np.uint64(255)), first
        at = stop


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not sum(map(len, keys)):
        return np.zeros(0, np.uint64), np.zeros(0)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(n, first)


def _distinct(keys: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how many of each where `weight` (None: everywhere) is true."""
    if weight is None or weight.all():
        k = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        return k[first], np.diff(np.append(first, len(k))).astype(np.uint32)
    a, n = _distinct(keys[weight], None)
    b, m = _distinct(keys[~weight], None)
    return _merge([a, b], [n, np.zeros_like(m)])


def _block_keys(data, offsets, train, depth):
    """The sorted distinct grams and words of a block, with training counts; chunks of like size are merged as they come, which bounds the memory."""
    grams, words = [], []
    for at, stop, codes, first in _gram_chunks(data, offsets, depth):
        grams.append(_distinct(codes, np.repeat(train[at:stop], np.diff(first))))
        while len(grams) > 1 and len(grams[-2][0]) < 2 * len(grams[-1][0]):
            grams[-2:] = [_merge(*map(list, zip(*grams[-2:], strict=True)))]
    starts, ends, first = W.word_bounds(data, offsets)
    for a, b in W.slices(first, 1 << 19):
        h = W.hash_words(data, starts[first[a] : first[b]], ends[first[a] : first[b]], True)
        words.append(_distinct(h, np.repeat(train[a:b], np.diff(first[a : b + 1]))))
    words.append((np.array([_END]), np.array([train.sum()], np.uint32)))
    return _merge(*map(list, zip(*grams, strict=True))) if grams else _merge([], []), _merge(*map(list, zip(*words, strict=True)))


def _gram_part(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    return (W.mix(keys >> np.uint64(8 * (depth - 1))) % np.uint64(parts)).astype(np.int64)


def _word_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


_PACKED = "block long, part int, keys binary, counts binary, ids binary, known binary, held binary, texts binary, sizes binary"


def _row(schema, **columns):
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


_PACKED_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((c, pa.large_binary()) for c in ("keys", "counts", "ids", "known", "held", "texts", "sizes"))])
_PACKED_ARROW = pa.schema([pa.field(f.name, pa.binary() if pa.types.is_large_binary(f.type) else f.type) for f in _PACKED_ARROW])


def _dealt(part: np.ndarray, parts: int, *arrays: np.ndarray):
    """The arrays, dealt by part with their order kept."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    arrays = [x[order] for x in arrays]
    return [[x[bounds[i] : bounds[i + 1]] for x in arrays] for i in range(parts)], order


def _pack(batches, depth: int, parts: int):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for kept in blocks_of(batches, ("doc_id", "held_out", "text"), "text", BLOCK):
        rows = pa.Table.from_batches(kept)
        data, offsets = W.text_buffer(rows["text"])
        held = rows["held_out"].to_numpy().astype(bool)
        known = ~np.asarray(rows["doc_id"].is_null())
        ids = np.asarray(rows["doc_id"].fill_null(0), np.int64)
        (grams, n), (words, m) = _block_keys(data, offsets, ~held, depth)
        dealt = _dealt(_gram_part(grams, depth, parts), parts, grams, n)[0] + _dealt(_word_part(words, parts), parts, words, m)[0]
        yield _row(_PACKED_ARROW, block=[block], part=[-1], ids=[ids.tobytes()], known=[known.tobytes()], held=[held.tobytes()], texts=[pa.compress(data.tobytes(), "zstd", asbytes=True)], sizes=[offsets.tobytes()])
        yield _row(_PACKED_ARROW, block=[block] * len(dealt), part=list(range(len(dealt))), keys=[k.tobytes() for k, _ in dealt], counts=[c.astype("<u8").tobytes() for _, c in dealt])
        block += 1


def _merge_group(key, rows):
    part = key[0].as_py()
    keys = [np.frombuffer(x.as_py(), "<u8") for x in rows["keys"]]
    counts = [np.frombuffer(x.as_py(), "<u8").astype(float) for x in rows["counts"]]
    k, n = _merge(keys, counts)
    return pa.table({"part": pa.array([part], pa.int32()), "salt": pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int64()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.astype("<u8").tobytes()], pa.binary())})


_MODEL = "part int, keys binary, counts binary, ones binary, total double, seen long, node array<int>, a array<double>, b array<double>, logs array<double>"


def _model_rows(batches, depth: int, parts: int):
    for batch in batches:
        for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts")), strict=True):
            k, n = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u8").astype(float)
            row = {"part": [part], "keys": [keys], "counts": [counts], "total": [float(n.sum())], "seen": [int((n > 0).sum())]}
            if part < parts and len(k):
                ones, (node, *sums) = part_tree(k, n, depth, min(2, depth))
                row |= {"counts": [None], "ones": [ones.astype("<f4").tobytes()], "node": [node.astype(np.int32)]} | dict(zip(("a", "b", "logs"), ([x] for x in sums), strict=True))
            schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ones", pa.binary()), ("total", pa.float64()), ("seen", pa.int64()), ("node", pa.list_(pa.int32())), *((c, pa.list_(pa.float64())) for c in ("a", "b", "logs"))])
            yield _row(schema, **row)


def _final_rows(batches, depth: int, parts: int, top):
    """The model's answer to each key: log10 probability of a gram, training count of a word."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("answers", pa.binary())])
    for batch in batches:
        for part, keys, counts, ones in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts", "ones")), strict=True):
            k = np.frombuffer(keys, "<u8")
            if part >= parts:
                answers = np.frombuffer(counts, "<u8").astype("<f8")
            elif len(k):
                answers = log10_probability(k, np.frombuffer(ones, "<f4").reshape(-1, 8).astype(float), top, depth).astype("<f4")
            else:
                answers = np.zeros(0, "<f4")
            yield _row(schema, part=[part], keys=[keys], answers=[answers.tobytes()])


def _answer(key, rows: pa.Table, *, parts: int):
    part = key[0].as_py()
    kind = "<f8" if part >= parts else "<f4"
    asked, model = [], None
    for block, keys, answers in zip(*(rows[c].to_pylist() for c in ("block", "keys", "answers")), strict=True):
        if answers is None:
            asked.append((block, np.frombuffer(keys, "<u8")))
        else:
            model = np.frombuffer(keys, "<u8"), np.frombuffer(answers, kind)
    out = [model[1][np.searchsorted(model[0], keys)].tobytes() for _, keys in asked]
    return pa.table({"block": pa.array([b for b, _ in asked], pa.int64()), "part": pa.array([part] * len(asked), pa.int32()), "answers": pa.array(out, pa.binary())})


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long"


def _score_block(key, rows: pa.Table, *, depth: int, parts: int, total: float, seen: int):
    by = {p: i for i, p in enumerate(rows["part"].to_pylist())}
    own = rows.slice(by[-1], 1).to_pylist()[0]
    data = np.frombuffer(pa.decompress(own["texts"], int(np.frombuffer(own["sizes"], np.int64)[-1]), "zstd", asbytes=True), np.uint8)
    offsets = np.frombuffer(own["sizes"], np.int64)
    held, known = np.frombuffer(own["held"], bool), np.frombuffer(own["known"], bool)
    (grams, _), (words, _) = _block_keys(data, offsets, ~held, depth)

    def answers(keys, part, base, kind):
        _, order = _dealt(part, parts)
        got = np.concatenate([np.frombuffer(rows["answers"][by[base + p]].as_py(), kind) for p in range(parts)])
        out = np.empty(len(keys))
        out[order] = got
        return out

    log_gram = answers(grams, _gram_part(grams, depth, parts), 0, "<f4")
    count = answers(words, _word_part(words, parts), parts, "<f8")
    n = len(offsets) - 1
    score, base, n_known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for at, stop, codes, first in _gram_chunks(data, offsets, depth):
        order = np.argsort(codes)
        ordered = codes[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        value = log_gram[np.searchsorted(grams, ordered[new])]
        out = np.empty(len(codes))
        out[order] = value[np.cumsum(new) - 1]
        score[at:stop] = np.add.reduceat(out, first[:-1])
    log_word = np.log10((count + 1) / (total + seen + 1))
    end = int(np.searchsorted(words, _END))
    starts, ends, first = W.word_bounds(data, offsets)
    for a, b in W.slices(first, 1 << 19):
        where = np.searchsorted(words, W.hash_words(data, starts[first[a] : first[b]], ends[first[a] : first[b]], True))
        bounds = first[a : b + 1] - first[a]
        sums = np.concatenate(([0.0], np.cumsum(log_word[where])))
        hits = np.concatenate(([0], np.cumsum(count[where] > 0)))
        base[a:b] = sums[bounds[1:]] - sums[bounds[:-1]] + log_word[end]
        n_known[a:b] = hits[bounds[1:]] - hits[bounds[:-1]] + int(count[end] > 0)
    return pa.table({
        "doc_id": pa.array(np.frombuffer(own["ids"], np.int64), pa.int64(), mask=~known), "held_out": pa.array(held), "n_tokens": pa.array(np.diff(first) + 1, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
        "train_tokens": pa.array([int(total)] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(score), "bytes": pa.array(np.diff(offsets), pa.int64()),
    })


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Scores every text of `docs` (doc_id, text, held_out boolean), learning from the rows that are not held out.

    Returns _SCORES and, as code_length, the text's bits a byte (its end included).  A null text counts as empty; an empty text has its end only.
    Rows with equal or null doc_id are scored each on its own.  Without training rows all counts are 0.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = max(32, partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    packed = saved(rows.mapInArrow(functools.partial(_pack, depth=depth, parts=parts), _PACKED), "ctw-packed")
    asked = packed.where("part >= 0").select("part", "block", "keys", "counts")
    blocks = packed.where("part = -1").count()
    if not blocks:
        return spark.createDataFrame([], _SCORES).withColumn("code_length", F.lit(0.0))
    merged = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks // FAN_IN)))))
    groups = -(-blocks // FAN_IN)
    while groups > 1:
        merged = merged.groupBy("part", "salt").applyInArrow(_merge_group, "part int, salt long, keys binary, counts binary")
        groups = -(-groups // FAN_IN)
        merged = saved(merged.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(groups))), "ctw-merged")
    merged = merged.groupBy("part").applyInArrow(_merge_group, "part int, salt long, keys binary, counts binary")
    model = saved(merged.mapInArrow(functools.partial(_model_rows, depth=depth, parts=parts), _MODEL), "ctw-model")
    total, seen = model.where(F.col("part") >= parts).agg(F.sum("total"), F.sum("seen")).first()
    top = model.where(F.col("part") < parts).select(F.explode(F.arrays_zip("node", "a", "b", "logs")).alias("x")).groupBy("x.node").agg(F.sum("x.a"), F.sum("x.b"), F.sum("x.logs")).toArrow()
    top = top_nodes(top.column(0).to_numpy().astype(np.int64), *(top.column(i).to_numpy().astype(float) for i in (1, 2, 3)))
    final = model.select("part", "keys", "counts", "ones").mapInArrow(functools.partial(_final_rows, depth=depth, parts=parts, top=top), "part int, keys binary, answers binary")
    salts = max(1, -(-blocks // FAN_IN))
    final = final.select("part", F.lit(None).cast("long").alias("block"), "keys", "answers", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    asked = asked.select("part", "block", "keys", F.lit(None).cast("binary").alias("answers"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    answered = final.unionByName(asked).groupBy("part", "salt").applyInArrow(_answering(parts), "block long, part int, answers binary")
    texts = packed.where("part = -1").select("block", "part", F.lit(None).cast("binary").alias("answers"), "ids", "known", "held", "texts", "sizes")
    for c in ("ids", "known", "held", "texts", "sizes"):
        answered = answered.withColumn(c, F.lit(None).cast("binary"))
    scored = texts.unionByName(answered).groupBy("block").applyInArrow(_scoring(depth, parts, float(total), int(seen)), _SCORES)
    return scored.withColumn("code_length", -F.col("score") / F.log10(F.lit(2.0)) / (F.col("bytes") + 1))


def _answering(parts: int):
    def answer(key, rows):
        return _answer(key, rows, parts=parts)

    return answer


def _scoring(depth: int, parts: int, total: float, seen: int):
    def score(key, rows):
        return _score_block(key, rows, depth=depth, parts=parts, total=total, seen=seen)

    return score


def op2_ctw_scores(spark, sf_dir: str) -> DataFrame:
    """The contract's scores of all documents; rows whose crc32(doc_id as text) mod 7 is 2 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")
