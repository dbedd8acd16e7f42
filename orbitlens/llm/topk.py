"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments; with means m and deviations s of each segment of length l, Cauchy and Schwarz give
<x, q> <= sum of l * (m_x m_q + s_x s_q), that is a lower bound on the distance |x - q|^2 = |x|^2 + |q|^2 - 2 <x, q>.  Bounds go from one segment to
finer ones; only candidates that no level rules out get their exact integer product.

Queries go in blocks of bounded bytes, taken from the input in order; each block meets all candidates where they lie, and only
each task's k best a query are shuffled.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Bytes of components in a block of queries that is sent to all tasks.
QUERY_BYTES = 8 << 20
#: Candidates that a task scores at a time.
ROWS = 1024
LEVELS = (1, 4, 16)
_EXACT = 2.0**53


def _segments(x: np.ndarray, pieces: int) -> np.ndarray:
    """Scaled means and deviations of the segments of each row, so that the product of two such rows bounds that of the vectors."""
    edges = np.linspace(0, x.shape[1], min(pieces, x.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    square = np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, edges[:-1], axis=1)
    return np.concatenate((mean * np.sqrt(length), np.sqrt(square)), axis=1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond 2**53 in Python's integers, held to the range of a long."""
    if len(q) and len(x) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= _EXACT:
        out = np.array([[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in x] for r in q], object).reshape(len(q), len(x))
        return np.clip(out, -(2**63), 2**63 - 1)
    return q @ x.T


class Best:
    """The k best candidates (id, score) of each query of a block, ties to the smaller id, of all that are given to `add`."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, levels=LEVELS):
        self.qid, self.q, self.k, self.levels = qid, q, k, levels
        self.ids, self.scores = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
        self.floor = np.full(len(qid), -np.inf)
        self.stats = [_segments(q, s) for s in levels]

    def add(self, cid: np.ndarray, x: np.ndarray) -> None:
        qid, q, k, n = self.qid, self.q, self.k, len(self.qid)
        small = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * q.shape[1] < _EXACT
        alive = np.ones((n, len(cid)), bool) if small else None
        if small and np.isfinite(self.floor).any():
            for stats, s in zip(self.stats, self.levels, strict=True):
                rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                if not len(rows) or not len(cols):
                    break
                bound = stats[rows] @ _segments(x[cols], s).T
                slack = 1e-6 + 1e-9 * np.abs(bound)
                alive[np.ix_(rows, cols)] &= bound + slack >= self.floor[rows, None]
            rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        else:
            rows, cols = np.arange(n), np.arange(len(cid))
        if not len(rows) or not len(cols):
            return
        got = _products(q[rows], x[cols])
        usable = qid[rows, None] != cid[cols][None]
        if alive is not None:
            usable &= alive[np.ix_(rows, cols)]
        kind = object if got.dtype == object or self.scores.dtype == object else float
        all_ids = np.concatenate((self.ids[rows], np.broadcast_to(cid[cols], got.shape)), axis=1)
        all_scores = np.concatenate((self.scores[rows].astype(kind), np.where(usable, got, np.nan).astype(kind)), axis=1)
        value = -all_scores.astype(float)
        if kind is object:
            order = np.array([sorted(range(len(r)), key=lambda j, r=r, i=i: (r[j] != r[j], -r[j] if r[j] == r[j] else 0, i[j])) for r, i in zip(all_scores, all_ids, strict=True)]).reshape(all_ids.shape)
        else:
            # keep the k best by value with all their ties, then order those few by value and id
            if value.shape[1] > 4 * k:
                cut = np.partition(value, k - 1, axis=1)[:, k - 1 : k]
                width = int(np.maximum((value <= cut).sum(1), 1).max())
                if width < value.shape[1]:
                    part = np.argsort(np.where(value <= cut, 0, 1), axis=1, kind="stable")[:, :width]
                    all_ids, all_scores, value = (np.take_along_axis(z, part, 1) for z in (all_ids, all_scores, value))
            order = np.lexsort((all_ids, value), axis=1)
        order = order[:, :k]
        new_ids, new_scores = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
        width = max(self.ids.shape[1], new_ids.shape[1])
        if self.ids.shape[1] < width:
            pad = ((0, 0), (0, width - self.ids.shape[1]))
            self.ids, self.scores = np.pad(self.ids, pad), np.pad(self.scores.astype(kind), pad, constant_values=np.nan)
        self.scores = self.scores.astype(kind)
        self.ids[rows, : new_ids.shape[1]], self.scores[rows, : new_ids.shape[1]] = new_ids, new_scores
        if width >= k:
            last = self.scores[:, k - 1].astype(float)
            self.floor = np.where(np.isnan(last), -np.inf, last)

    def rows(self):
        """(query index, id, score) of what was found."""
        for i in range(len(self.qid)):
            for v, s in zip(self.ids[i], self.scores[i], strict=True):
                if s == s:
                    yield i, int(v), int(s)


def _vectors(batch: pa.RecordBatch):
    """Ids and component rows of a record batch (id, components), by length."""
    ids = np.asarray(batch.column(0))
    lists = batch.column(1)
    sizes = np.asarray(lists.value_lengths())
    flat, at = np.asarray(lists.flatten(), float), np.concatenate(([0], np.cumsum(sizes)))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), ids[rows], flat[(at[rows][:, None] + np.arange(size))]


def _search(batches, blocks: dict, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    best: dict[int, Best] = {}
    for batch in batches:
        for size, ids, x in _vectors(batch):
            if size in blocks:
                if size not in best:
                    best[size] = Best(*blocks[size], k)
                own = best[size]
                for at in range(0, len(ids), ROWS):
                    own.add(ids[at : at + ROWS], x[at : at + ROWS])
    for size, own in best.items():
        found = list(own.rows())
        qid = blocks[size][0]
        columns = [qid[[f[0] for f in found]] if found else [], [f[1] for f in found], [f[2] for f in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): floor(256 * component) of the rows with an id and only finite components."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(x) > 0))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row that `is_query` (a condition) selects.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; vectors meet those of their own length.
    Every other row is a candidate: repeated rows, with equal vec_ids and vectors, each take a rank of their own.
    Rows with a query's id count as the query's own.  Equal query ids are answered once, for the least of their vectors.  Products beyond a long are held to its range.  No queries or an empty table give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding).mapInArrow(_scaled, "vec_id long, x array<double>")
    rows = saved(rows, "vectors")
    queries = saved(rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).repartitionByRange(F.col("vec_id")).sortWithinPartitions("vec_id"), "queries")
    out = None
    for block in _query_blocks(queries):
        part = rows.mapInArrow(functools.partial(_search, blocks=block, k=k), "query_id long, vec_id long, score long")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = saved(part, "best")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _scaled(batches):
    for batch in batches:
        x = batch.column(1)
        flat = np.floor(np.asarray(x.flatten(), float) * 256)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.asarray(x.value_lengths())))), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["vec_id", "x"])


def _query_blocks(queries: DataFrame):
    """Blocks of at most QUERY_BYTES of queries (one query at least), by vector length: {length: (ids, vectors)}."""
    ids: dict[int, list] = {}
    held = 0
    for row in queries.toLocalIterator(prefetchPartitions=False):
        ids.setdefault(len(row["x"]), []).append((row["vec_id"], row["x"]))
        held += 8 * len(row["x"])
        if held >= QUERY_BYTES:
            yield {n: (np.array([i for i, _ in v], np.int64), np.array([x for _, x in v])) for n, v in ids.items()}
            ids, held = {}, 0
    if ids:
        yield {n: (np.array([i for i, _ in v], np.int64), np.array([x for _, x in v])) for n, v in ids.items()}


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The contract's search: rows whose vec_id is divisible by 50 against all others, 5 best."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, k::INT AS rank, vec_id, score FROM r WHERE k <= 5
"""
