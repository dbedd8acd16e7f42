"""Quality classifier: a byte-level convolutional network in numpy.

A text is read in chunks of CHUNK bytes that overlap by CHUNK - STRIDE and cover all of it.  Every byte comes with one of four marks: how far back in
the chunk its run of four bytes stood last.  A filter sums a learned weight for each (place, byte, mark) of WIDTH bytes; each chunk keeps every filter's largest answer,
and the document's mean and maximum over its chunks, rectified, make one logistic probability.

Training takes a bounded sample of labelled rows (ROWS of each class, BYTES of text in all, in the order of a hash) on the driver.
Only the bytes that gave a chunk's largest answer get gradients.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import release, remainder, table

CHUNK, STRIDE, WIDTH, FILTERS = 1024, 896, 8, 12
#: Bounds of the training sample: rows of each class, and bytes of text in all.
ROWS, BYTES = 1200, 8 << 20
#: Passes over the sample; a small one is passed more often, up to STEPS batches in all.
EPOCHS, STEPS, RATE, THRESHOLD = 6, 450, 0.02, 0.7
_SYMBOLS = 1024  # byte and mark


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts as rows of symbols (byte * 4 + mark; shorter texts are filled with 255, which UTF-8 never has), and each chunk's text."""
    sizes = np.diff(offsets)
    count = np.where(sizes <= CHUNK, 1, -(-(sizes - CHUNK) // STRIDE) + 1)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    place = nth[:, None] * STRIDE + np.arange(CHUNK)
    inside = place < sizes[text][:, None]
    padded = np.concatenate((data, np.zeros(1, np.uint8)))
    rows = padded[np.where(inside, offsets[:-1][text][:, None] + place, len(data))]
    rows[~inside] = 255
    code = np.zeros((len(rows), CHUNK), np.int64)
    wide = rows.astype(np.int64)
    code[:, : CHUNK - 3] = wide[:, : CHUNK - 3] | wide[:, 1 : CHUNK - 2] << 8 | wide[:, 2 : CHUNK - 1] << 16 | wide[:, 3:] << 24
    code[:, CHUNK - 3 :] = -1 - np.arange(3)
    code = (code << 10) | np.arange(CHUNK)
    code.sort(axis=1)
    at = code & 1023
    same = np.zeros(code.shape, bool)
    same[:, 1:] = (code[:, 1:] >> 10) == (code[:, :-1] >> 10)
    back = np.zeros(code.shape, np.int64)
    back[:, 1:] = at[:, 1:] - at[:, :-1]
    mark = np.where(same, np.where(back <= 32, 1, np.where(back <= 192, 2, 3)), 0)
    marks = np.empty_like(mark)
    np.put_along_axis(marks, at, mark, axis=1)
    marks[~inside] = 0
    return (rows.astype(np.int16) << 2) | marks.astype(np.int16), text


def answers(rows: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter in each chunk, and where it begins."""
    best = np.empty((len(rows), filters.shape[2]), np.float32)
    where = np.empty(best.shape, np.int64)
    for at in range(0, len(rows), 16):
        part = rows[at : at + 16]
        out = np.zeros((len(part), CHUNK - WIDTH + 1, filters.shape[2]), np.float32)
        for k in range(WIDTH):
            out += filters[k][part[:, k : k + CHUNK - WIDTH + 1]]
        where[at : at + 16] = out.argmax(1)
        best[at : at + 16] = out.max(1)
    return best, where


def _pooled(best: np.ndarray, text: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rectified answers by chunk, and their mean and maximum by text."""
    active = np.maximum(best + bias, 0)
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    count = np.diff(np.append(first, len(text)))
    return active, np.add.reduceat(active, first) / count[:, None], np.maximum.reduceat(active, first)


class Network:
    def __init__(self, filters: int = FILTERS, seed: int = 7):
        r = np.random.default_rng(seed)
        self.filters = (r.standard_normal((WIDTH, _SYMBOLS, filters)) * 0.05).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.mean = r.standard_normal(filters).astype(np.float32) * 0.3
        self.top = r.standard_normal(filters).astype(np.float32) * 0.3
        self.offset = np.float32(0)

    def logits(self, rows: np.ndarray, text: np.ndarray) -> np.ndarray:
        _, mean, top = _pooled(answers(rows, self.filters)[0], text, self.bias)
        return mean @ self.mean + top @ self.top + self.offset

    def score(self, column) -> np.ndarray:
        """Probability of label 1 for each text of an Arrow column."""
        data, offsets = W.text_buffer(column)
        out = np.empty(len(offsets) - 1)
        at = 0
        while at < len(out):
            stop = max(int(np.searchsorted(offsets, offsets[at] + (1 << 18), "right")) - 1, at + 1)
            stop = min(stop, at + 128)
            out[at:stop] = self._scores(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
            at = stop
        return out

    def _scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(data) > 1 << 22:  # one very long text: its chunks' answers, stretch by stretch
            total, top, chunks, at = np.zeros(len(self.bias)), np.full(len(self.bias), -np.inf), 0, 0
            step = STRIDE * 2048
            while True:
                part = data[at : at + step + CHUNK - STRIDE]
                active = np.maximum(answers(symbols(part, np.array([0, len(part)]))[0], self.filters)[0] + self.bias, 0)
                total, top, chunks = total + active.sum(0), np.maximum(top, active.max(0)), chunks + len(active)
                at += step
                if at + CHUNK - STRIDE >= len(data):
                    break
            z = np.array([(total / chunks) @ self.mean + top @ self.top + self.offset])
        else:
            z = self.logits(*symbols(data, offsets))
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def train(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> None:
        """Adam for the small weights, AdaGrad for the filters, over batches of texts."""
        r = np.random.default_rng(seed)
        data, offsets = W.text_buffer(pa.array(texts, pa.large_string()))
        parts, at = [], 0
        while at < len(texts):  # a stretch of texts at a time: the marks need wide intermediates
            stop = max(int(np.searchsorted(offsets, offsets[at] + (1 << 18), "right")) - 1, at + 1)
            part, own = symbols(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
            parts.append((part, own + at))
            at = stop
        rows, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        squares = np.full(self.filters.shape, 1e-3, np.float32)
        state = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in ("bias", "mean", "top", "offset")}
        step = 0
        for _ in range(max(epochs, STEPS // -(-len(texts) // 32))):
            order = r.permutation(len(texts))
            for at in range(0, len(order), 32):
                pick = order[at : at + 32]
                own = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
                doc = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
                x = rows[own]
                best, where = answers(x, self.filters)
                active, mean, top = _pooled(best, doc, self.bias)
                p = 1 / (1 + np.exp(-np.clip(mean @ self.mean + top @ self.top + self.offset, -30, 30)))
                d = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
                count = np.bincount(doc).astype(np.float32)
                is_top = active >= top[doc]
                share = is_top / np.add.reduceat(is_top, np.searchsorted(doc, np.arange(len(pick))))[doc]
                grad = d[doc, None] * (self.mean / count[doc, None] + self.top * share) * (best + self.bias > 0)
                grads = {"bias": grad.sum(0), "mean": d @ mean, "top": d @ top, "offset": d.sum()}
                step += 1
                for n, g in grads.items():
                    m, v = state[n]
                    m[...] = 0.9 * m + 0.1 * g
                    v[...] = 0.99 * v + 0.01 * g * g
                    setattr(self, n, (getattr(self, n) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
                c, f = np.nonzero(grad)
                for k in range(WIDTH):
                    s = x[c, where[c, f] + k].astype(np.int64)
                    cell, back = np.unique(s * self.filters.shape[2] + f, return_inverse=True)
                    g = np.bincount(back, grad[c, f]).astype(np.float32)
                    flat, sq = self.filters[k].reshape(-1), squares[k].reshape(-1)
                    sq[cell] += g * g
                    flat[cell] -= rate * g / np.sqrt(sq[cell])


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, limit: int = BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights for training: of each class the documents least by a hash, as far as `rows` and half of `limit` bytes go.

    Documents with remainder 2 (the held-out ones), null labels and texts longer than half of `limit` are never taken; of several labels of a document the
    largest counts, of several rows with its doc_id the one with the shortest text (least by hash among those).  Weights restore the classes' shares.
    Only doc_id, size and hash meet the labels; the chosen texts, `limit` bytes in all, are fetched by a filter on the table itself.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(remainder("doc_id", 4) != 2)
    counts = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", F.struct(F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash")).alias("x")).where(F.col("x.size") <= limit // 2)
    least = sized.join(marks, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).withColumn("order", F.xxhash64("doc_id"))
    found: dict[int, list] = {}
    part = {label: 2 * rows / n for label, n in counts.items()}
    while part:  # hashes are even, so about twice the rows wanted lie below the first bound; labels without a document take another turn
        below = [(F.col("quality") == label) & (F.col("order") <= min(int(share * 2**64) - 2**63, 2**63 - 1)) for label, share in part.items()]
        got = least.where(functools.reduce(lambda a, b: a | b, below)).select("order", "doc_id", "quality", "x.size", "x.hash").collect()
        for label in [*part]:
            found[label] = sorted((r for r in got if r["quality"] == label), key=lambda r: (r["order"], r["doc_id"]))[:rows]
            part[label] *= 4
            if len(found[label]) == rows or part[label] >= 4:
                del part[label]
    chosen = {}
    for label, ranked in sorted(found.items()):
        used = 0
        for r in ranked:
            if used + r["size"] <= limit // 2:
                chosen[r["doc_id"], r["hash"]] = label
                used += r["size"]
    if not chosen:
        return [], np.zeros(0, np.float32), np.zeros(0, np.float32)
    ids, hashes = (sorted({k[i] for k in chosen}) for i in (0, 1))
    rows_of = docs.where(F.col("doc_id").isin(ids)).select("doc_id", text.alias("text")).withColumn("hash", F.xxhash64("text")).where(F.col("hash").isin(hashes))
    got = rows_of.groupBy("doc_id", "hash").agg(F.min("text").alias("text")).collect()
    got = [(r["text"], chosen[r["doc_id"], r["hash"]]) for r in got if (r["doc_id"], r["hash"]) in chosen]
    y = np.array([label for _, label in got], np.float32)
    size = {label: max(int((y == label).sum()), 1) for label in counts}
    weights = np.array([counts[label] / sum(counts.values()) * 2 / size[label] for _, label in got], np.float32)
    return [t for t, _ in got], y, weights * (len(weights) / max(weights.sum(), 1e-9))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network trained on the bounded sample; without any labels of both classes it answers 0.5 plus nothing it knows."""
    texts, y, weights = sample(docs, labels)
    net = Network()
    if len(set(y.tolist())) == 2:
        order = sorted(range(len(texts)), key=lambda i: (texts[i], y[i]))
        net.train([texts[i] for i in order], y[order], weights[order])
    else:
        net.mean[:], net.top[:] = 0, 0
    release()
    return net


def _score_rows(batches, net: Network, threshold: float):
    for batch in batches:
        score = net.score(batch.column(batch.schema.get_field_index("text")))
        extra = {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])
        release()


def classify(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with score and predicted (columns of those names are replaced).

    Every row gets a score from its text alone; null counts as empty.  Equal texts get equal scores; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return docs.mapInArrow(functools.partial(_score_rows, net=net, threshold=threshold), f"{schema}, score double, predicted int")


def _good_rows(batches, net: Network, threshold: float):
    for batch in batches:
        yield batch.filter(pa.array(net.score(batch.column(batch.schema.get_field_index("text"))) >= threshold))
        release()


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores at least the threshold."""
    return docs.mapInArrow(functools.partial(_good_rows, net=net, threshold=threshold), docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
