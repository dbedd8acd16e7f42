"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence.

A document's row holds its distinct word shingles.  Two documents link when num/den of the union of their shingles is shared.
Every bound follows from the sizes: sizes a <= b can only link if den*a >= num*b, and they must share at least
ceil(num*(a+b)/(num+den)) shingles, so with all rows in one order of columns (rarest first) linked documents meet within their
first a - ceil(num*a/den) + 1 columns, at a first common column that leaves enough behind it.

Steps: (1) documents with equal sets fall into one class; (2) the columns that several texts of a task share are counted, and the most frequent
(at most FREQUENT, an order only, so any choice gives the same links) come last; (3) in each column of the heads, the class with the smallest doc_id is
multiplied with the others: those pairs' overlaps are accumulated, first over the heads, which rules out most pairs (of the two heads the one that ends first
holds all of its common columns in the other, so the overlap is at most the heads' plus what lies beyond), then in blocks over their whole rows; (4) components are formed; in columns that still hold several
of them the class that shares most columns is multiplied with the other components; (5) what is left gives all its pairs across components.  Pairs within a
component are not multiplied again, so a group of copies costs about one product a member; no link between components is lost.

Links themselves (`jaccard_links`, `link_counts`) lie inside components, so there each component's classes are multiplied block by block with all others of it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, saved, scratch, sliced, table
from .components import components

#: Most columns that are sent to all tasks as frequent ones (16 bytes each).
FREQUENT = 1 << 17
#: Columns that a task counts at a time; beyond it those met once so far are forgotten, which touches their order only.
COUNTED = 1 << 18
#: Bits of the table that preselects texts for the product (by hash: a false hit costs time only).
FILTER = 1 << 20
#: Pairs to a block of the product.
BLOCK = 256
#: Classes and cells to a block of a component's classes, where all its links are wanted.
LINK_BLOCK = 512
LINK_CELLS = 1 << 18
#: Columns multiplied densely at a time.
DENSE = 4096


def need(num: int, den: int, a, b):
    """Fewest common shingles of linked sets of sizes a and b."""
    return -((-num * (a + b)) // (num + den))


def head(num: int, den: int, n):
    """Columns of a set of n among which it meets every set linked to it."""
    return n - (-((-num * n) // den)) + 1


def _sets(batch: pa.RecordBatch, n: int):
    """Shingle hashes by text, bounds, sizes, and each set's number (0 for no set): a 64-bit hash of the whole set."""
    keys, owner = W.shingles_of(batch.column(batch.schema.get_field_index("text")), n)
    size = np.bincount(owner, minlength=batch.num_rows)
    bounds = np.concatenate(([0], np.cumsum(size)))
    sums = []
    for salt in (0x51, 0xA3):
        total = np.concatenate(([np.uint64(0)], np.cumsum(W.mix(keys ^ np.uint64(salt)))))
        sums.append(total[bounds[1:]] - total[bounds[:-1]])
    node = W.mix(sums[0] ^ W.mix(sums[1] + size.astype(np.uint64))).view(np.int64)
    return keys, owner, bounds, size, np.where(size > 0, node, 0)


def _new(node: np.ndarray, seen: set) -> np.ndarray:
    """Which rows hold a set that this task hasn't met."""
    fresh = np.zeros(len(node), bool)
    first = np.unique(node, return_index=True)[1]
    for i in first:
        if (v := int(node[i])) and v not in seen:
            seen.add(v)
            fresh[i] = True
    return fresh


_SETS = "doc_id long, n_shingles long, node long, key long, shingle long, rows long"


def _set_rows(batches, n: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_shingles", "node", "key", "shingle", "rows")])
    seen: set[int] = set()
    counted = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in sliced(batches, "text"):
        keys, owner, _, size, node = _sets(batch, n)
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(node, mask=size == 0), batch.column(1), none, none], schema=schema)
        k, c = np.unique(keys[_new(node, seen)[owner]], return_counts=True)
        k, back = np.unique(np.concatenate((counted[0], k)), return_inverse=True)
        c = np.bincount(back, np.concatenate((counted[1], c)), len(k)).astype(np.int64)
        kept = (c > 1) | (len(k) <= COUNTED)
        counted = k[kept], c[kept]
    often = counted[1] > 1
    k, c = counted[0][often].view(np.int64), counted[1][often]
    none = pa.nulls(len(k), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(k), pa.array(c)], schema=schema)


_HEADS = "shingle long, node long, n int, pos int"


def _head_rows(batches, n: int, num: int, den: int, frequent: np.ndarray, counts: np.ndarray):
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
    seen: set[int] = set()
    for batch in sliced(batches, "text"):
        keys, owner, _, size, node = _sets(batch, n)
        mine = _new(node, seen)[owner]
        keys, owner = keys[mine], owner[mine]
        order = np.zeros(len(keys), np.int64)
        if len(frequent) and len(keys):
            at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
            order = np.where(frequent[at] == keys, counts[at], 0)
        by = np.lexsort((keys, order, owner))
        keys, owner = keys[by], owner[by]
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        pos = np.arange(len(keys)) - first[owner]
        kept = pos < head(num, den, size)[owner]
        keys, owner, pos = keys[kept], owner[kept], pos[kept]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node[owner]), pa.array(size[owner].astype(np.int32)), pa.array(pos.astype(np.int32))], schema=schema)


_ROWS = "node long, row binary"


def _matrix_rows(batches, n: int, bits: np.ndarray):
    schema = pa.schema([("node", pa.int64()), ("row", pa.binary())])
    seen: set[int] = set()
    for batch in sliced(batches, "text"):
        key = np.asarray(batch.column(0).fill_null(0))
        batch = batch.filter(pa.array(bits[key.view(np.uint64) % np.uint64(len(bits))]))
        if not batch.num_rows:
            continue
        keys, _, bounds, _, node = _sets(batch, n)
        rows = np.flatnonzero(_new(node, seen))
        yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array([keys[bounds[i] : bounds[i + 1]].tobytes() for i in rows], pa.binary())], schema=schema)


def block_product(left: list[bytes], right: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of rows left[a] and right[b]: the product of two sparse blocks, read at those cells."""
    out = np.zeros((len(left), len(right)), np.int64)
    lk, rk = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows]) for rows in (left, right))
    lo, ro = (np.repeat(np.arange(len(rows)), [len(x) // 8 for x in rows]) for rows in (left, right))
    order = np.argsort(rk, kind="stable")
    rk, ro = rk[order], ro[order]
    begin, end = np.searchsorted(rk, lk, "left"), np.searchsorted(rk, lk, "right")
    for at in range(0, len(lk), 4096):
        s, count = begin[at : at + 4096], (end - begin)[at : at + 4096]
        total = int(count.sum())
        where = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(s, count)
        out += np.bincount(np.repeat(lo[at : at + 4096], count) * len(right) + ro[where], minlength=out.size).reshape(out.shape)
    return out[a, b]


def _link_rows(batches, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            a, b, ra, rb = (part.column(i) for i in range(4))
            a, b, ra, rb = np.asarray(a), np.asarray(b), ra.to_pylist(), rb.to_pylist()
            _, fa, ia = np.unique(a, return_index=True, return_inverse=True)
            _, fb, ib = np.unique(b, return_index=True, return_inverse=True)
            overlap = block_product([ra[i] for i in fa], [rb[i] for i in fb], ia, ib)
            union = np.array([(len(x) + len(y)) // 8 for x, y in zip(ra, rb, strict=True)]) - overlap
            linked = den * overlap >= num * union
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked]), pa.array(overlap[linked])], schema=schema)


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Overlaps of all rows of two blocks: columns that many rows share by a dense product, the others by a sparse one."""
    out = np.zeros((len(left), len(right)), np.int64)
    keys = [np.concatenate([np.frombuffer(x, np.uint64) for x in rows]) for rows in (left, right)]
    shared = np.intersect1d(*keys)
    if not len(shared):
        return out
    row, col = [], []
    for rows, k in zip((left, right), keys, strict=True):
        at = np.minimum(np.searchsorted(shared, k), len(shared) - 1)
        same = shared[at] == k
        row.append(np.repeat(np.arange(len(rows)), [len(x) // 8 for x in rows])[same])
        col.append(at[same])
    count = [np.bincount(c, minlength=len(shared)) for c in col]
    dense = 64 * count[0] * count[1] >= out.size
    number = np.cumsum(dense) - 1
    inside = [dense[c] for c in col]
    for first in range(0, int(dense.sum()), DENSE):
        cells = []
        for rows, r, c, own in zip((left, right), row, col, inside, strict=True):
            at = number[c[own]] - first
            here = (at >= 0) & (at < DENSE)
            block = np.zeros((len(rows), min(DENSE, int(dense.sum()) - first)), np.float32)
            block[r[own][here], at[here]] = 1
            cells.append(block)
        out += (cells[0] @ cells[1].T).astype(np.int64)
    (lr, lc), (rr, rc) = ((r[~own], c[~own]) for r, c, own in zip(row, col, inside, strict=True))
    rr = rr[np.argsort(rc, kind="stable")]
    count[1][dense] = 0
    begin = np.cumsum(count[1]) - count[1]
    for at in range(0, len(lc), 1 << 16):
        b, n = begin[lc[at : at + (1 << 16)]], count[1][lc[at : at + (1 << 16)]]
        where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b, n)
        np.add.at(out, (np.repeat(lr[at : at + (1 << 16)], n), rr[where]), 1)
    return out


def _inside_rows(batches, num: int, den: int):
    """Links between the classes of two blocks (lo, hi) of a component; the rows of such a pair follow each other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])

    def linked(members):
        part, node = (np.array([m[i] for m in members]) for i in (3, 4))
        lo, hi = members[0][1:3]
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        if not len(left) or not len(right):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, schema=schema)
        size = np.array([len(m[5]) // 8 for m in members])
        shared = overlaps([members[i][5] for i in left], [members[i][5] for i in right])
        hit = den * shared >= num * (size[left][:, None] + size[right][None] - shared)
        if lo == hi:
            hit &= node[left][:, None] < node[right][None]
        i, j = np.nonzero(hit)
        a, b = node[left[i]], node[right[j]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shared[i, j])], schema=schema)

    members = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if members and members[-1][:3] != row[:3]:
                yield linked(members)
                members = []
            members.append(row)
    if members:
        yield linked(members)


def _labelled(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, node, key, component) for each row, written: key is the text's hash, node its set's, component its component's (null without shingles)."""
    with scratch() as own:
        return own.keep(saved(_label(docs, n, num, den), "labelled"))


def _label(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    num, den = int(num), int(den)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    first = saved(texts.select("doc_id", "key", "text").mapInArrow(functools.partial(_set_rows, n=n), _SETS), "sets")
    sets = first.where("shingle is null").select("doc_id", "n_shingles", "node", "key")
    often = first.where("shingle is not null").groupBy("shingle").agg(F.sum("rows").alias("rows")).where("rows >= 4").orderBy(F.desc("rows"), "shingle").limit(FREQUENT).toArrow()
    keys = often["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent, counts = keys[order], often["rows"].to_numpy().astype(np.int64)[order]
    heads = saved(texts.select("text").mapInArrow(functools.partial(_head_rows, n=n, num=num, den=den, frequent=frequent, counts=counts), _HEADS), "heads")
    # columns in the heads of two classes at least
    shared = saved(heads.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("shingle"), "shared")
    by_node = sets.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"))
    cells = heads.join(shared, "shingle", "left_semi").groupBy("shingle", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    cells = saved(cells.join(by_node, "node").withColumn("rank", F.coalesce("doc_id", "node")).drop("doc_id"), "cells")

    discard(heads)

    def bound(x, y):
        least = -F.floor(-num * (F.col(f"{x}.n") + F.col(f"{y}.n")) / F.lit(num + den))
        rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
        return (rest >= least) & (den * F.least(f"{x}.n", f"{y}.n") >= num * F.greatest(f"{x}.n", f"{y}.n"))

    def ends(x, y):
        return F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")

    tops = saved(cells.groupBy("node").agg(F.first("n").cast("long").alias("n"), F.collect_list("shingle").alias("top")), "tops")

    def promising(pairs: DataFrame) -> DataFrame:
        """The pairs whose heads share enough columns for the bound."""
        for end in ("b", "a"):
            pairs = pairs.join(tops.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("top").alias(f"top_{end}")), end)
        least = -F.floor(-num * (F.col("n_a") + F.col("n_b")) / F.lit(num + den))
        beyond = -F.floor(-num * F.greatest("n_a", "n_b") / F.lit(den)) - 1
        return pairs.where(F.size(F.array_intersect("top_a", "top_b")) + beyond >= least).select("a", "b")

    def multiplied(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a, b): only the rows of the matrix that they name are made, from the texts anew."""
        pairs = saved(promising(pairs), "pairs")
        nodes = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "pair-nodes")
        used = nodes.join(cells.select("node", "key").distinct(), "node").select(F.pmod("key", F.lit(FILTER)).alias("bit")).distinct().toArrow()["bit"].to_numpy().astype(np.int64)
        if not len(used):
            return pairs
        bits = np.zeros(FILTER, bool)
        bits[used] = True
        matrix = texts.select("key", "text").mapInArrow(functools.partial(_matrix_rows, n=n, bits=bits), _ROWS).join(nodes, "node", "left_semi")
        matrix = saved(matrix.dropDuplicates(["node"]), "matrix")
        rows = pairs.join(matrix.withColumnsRenamed({"node": "b", "row": "row_b"}), "b").join(matrix.withColumnsRenamed({"node": "a", "row": "row_a"}), "a")
        links = saved(rows.select("a", "b", "row_a", "row_b").mapInArrow(functools.partial(_link_rows, num=num, den=den), "a long, b long, overlap long"), "links")
        discard(matrix, pairs, nodes)
        return links

    def pivots_of(columns: DataFrame) -> DataFrame:
        """The cells of each column's least rank; written on both sides of the join, so that Spark can split a hot column's rows there and in the next one."""
        least = saved(columns.groupBy("shingle").agg(F.min("rank").alias("least")), "least")
        return saved(columns.join(least, "shingle").where("rank = least").drop("least"), "pivots")

    def mixed_columns(found: DataFrame) -> DataFrame:
        """The cells of the columns that hold several components, with those."""
        marked = cells.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = saved(marked.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle"), "several")
        return saved(marked.join(several, "shingle", "left_semi"), "mixed")

    def widened(found: DataFrame, links: DataFrame) -> DataFrame:
        """Components after further links: only those that the links join are formed anew."""
        if links.limit(1).count() == 0:
            return found
        names = found.select(F.col("node"), F.col("component"))
        for end in ("a", "b"):
            links = links.join(names.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
        joined = components(links.select("a", "b"))
        old = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
        out = saved(old.unionByName(joined.join(found, "node", "left_anti").select("node", "component")).distinct(), "components")
        discard(joined)
        return out

    same = F.col("x.shingle") == F.col("y.shingle")
    pairs = pivots_of(cells).alias("x").join(cells.alias("y"), same & (F.col("x.node") != F.col("y.node")) & bound("x", "y"))
    links = multiplied(pairs.select(*ends("x", "y")).distinct())
    found = components(links.select("a", "b"))
    discard(links)
    for last in (False, True):
        mixed = mixed_columns(found)
        if not last:
            # the class that meets others in most columns is the likeliest to link with all copies
            often = mixed.groupBy("node").agg(F.count("*").alias("columns"))
            ranked = mixed.drop("rank").join(often, "node").withColumn("rank", -F.shiftleft("columns", 32) + F.pmod("node", F.lit(1 << 31)))
            apart = same & (F.col("x.component") != F.col("y.component")) & bound("x", "y")
            pairs = pivots_of(ranked).alias("x").join(ranked.alias("y"), apart)
        else:
            # all that is left: pairs across components with an end outside the column's main one
            home = saved(pivots_of(mixed).groupBy("shingle").agg(F.min("component").alias("home")), "home")
            outside = saved(mixed.join(home, "shingle").where("component <> home"), "outside").alias("x")
            apart = same & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("x.home")) | (F.col("x.node") < F.col("y.node"))) & bound("x", "y")
            pairs = outside.join(mixed.alias("y"), apart)
        links = multiplied(pairs.select(*ends("x", "y")).distinct())
        found, before = widened(found, links.select("a", "b")), found
        discard(links, mixed)
        if found is not before:
            discard(before)

    return sets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def ngram_jaccard_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text): links join sets that share num/den or more of their union.

    Null, empty and blank texts have no shingles, link with nothing and are their own component.  component_id is the smallest doc_id of the component, null
    if all are null.  Rows with equal doc_id are documents of their own; repeated rows share a class.  An empty table gives no rows.
    """
    return _named(_labelled(docs, n, num, den)).select("doc_id", "n_shingles", "component_id")


def _named(labelled: DataFrame) -> DataFrame:
    """The rows of `_labelled` with component_id."""
    # written, so that Spark can split a large component's rows over tasks in the join
    least = saved(labelled.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    out = labelled.join(least, "component", "left")
    return out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def _inside(labelled: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b, overlap) of all linked classes a < b, written: every component's classes in blocks, every block times itself and the others."""
    with scratch() as own:
        return own.keep(saved(_inside_links(labelled, docs, n, num, den), "inside"))


def _inside_links(labelled: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    classes = labelled.where("node is not null").groupBy("component", "node").agg(F.min("key").alias("key"), F.first("n_shingles").alias("cells"))
    parts = F.greatest(F.ceil(F.count("*") / LINK_BLOCK), F.ceil(F.sum("cells") / LINK_CELLS)).cast("long")
    several = classes.groupBy("component").agg(parts.alias("parts"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    classes = saved(classes.join(several, "component").drop("cells"), "classes")
    used = classes.select(F.pmod("key", F.lit(FILTER)).alias("bit")).distinct().toArrow()["bit"].to_numpy().astype(np.int64)
    if not len(used):
        return docs.sparkSession.createDataFrame([], "a long, b long, overlap long")
    bits = np.zeros(FILTER, bool)
    bits[used] = True
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("key"), "text")
    matrix = texts.mapInArrow(functools.partial(_matrix_rows, n=n, bits=bits), _ROWS).join(classes.drop("key"), "node").dropDuplicates(["node"])
    own, other = F.col("part"), F.col("other")
    matrix = matrix.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = matrix.select("component", F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), "part", "node", "row")
    blocks = blocks.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return blocks.mapInArrow(functools.partial(_inside_rows, num=int(num), den=int(den)), "a long, b long, overlap long")


def jaccard_links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links, as members (doc_id, n_shingles, node) and (a, b, overlap): two rows link if they have the same node or if their nodes are a pair, a < b.

    A node is a class of rows with equal sets (null without shingles, which links with nothing); overlap is the number of common shingles.
    """
    labelled = _labelled(docs, n, num, den)
    return labelled.select("doc_id", "n_shingles", "node"), _inside(labelled, docs, n, num, den)


def link_counts(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of `docs`: as `ngram_jaccard_join`, with the number of other rows that it links with."""
    labelled = _labelled(docs, n, num, den)
    size = labelled.where("node is not null").groupBy("node").agg(F.count("*").alias("size"))
    links = _inside(labelled, docs, n, num, den)
    both = links.select(F.col("a").alias("end"), F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("end"), F.col("a").alias("node")))
    met = both.join(size, "node").groupBy("end").agg(F.sum("size").alias("met")).withColumnRenamed("end", "node")
    counted = size.join(met, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    out = _named(labelled).join(counted, "node", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs`, all columns as they are, that stay: of each component the one with the smallest doc_id (null last), and all texts without shingles.

    Of rows with equal doc_id and text one stays, those without shingles included.
    """
    key, own = "__text_key", "__doc_key"
    labelled = _labelled(docs, n, num, den).select("component", F.coalesce("doc_id", F.lit(2**63 - 1)).alias(own), F.col("key").alias(key))
    chosen = labelled.where("component is not null").groupBy("component").agg(F.min(F.struct(own, key)).alias("x")).select(f"x.{own}", f"x.{key}")
    chosen = chosen.unionByName(labelled.where("component is null").select(own, key)).distinct()
    rows = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(chosen, [own, key], "left_semi").dropDuplicates([own, key]).drop(own, key)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The contract's components over all documents: 3-word shingles, 90 of 100."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), 3, 90, 100)


def op3_link_counts(spark, sf_dir: str) -> DataFrame:
    """The same components with each document's number of links."""
    return link_counts(table(spark, sf_dir, "documents"), 3, 90, 100)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.seen) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY ALL
"""

#: The same links, counted by document.
LINK_ORACLE = ORACLE.replace("AS component_id", "AS component_id, coalesce(t.k, 0) AS n_links").replace(
    "USING (doc_id) JOIN r", "USING (doc_id) LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) t ON t.a = d.doc_id JOIN r"
)
