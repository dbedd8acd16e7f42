"""Best-fit packing of tokenized documents into sequences, by large-item matching.

Pieces longer than a third of the capacity go at most two to a sequence: from the longest down, each takes the longest partner
that still fits.  Shorter pieces, from the longest down, go to the smallest gap that holds them, or else open new sequences.

Only lengths decide, so the plan is made from the histogram of lengths (at most `capacity` counts), with as many equal sequences at a time as there are.  A piece finds its
place by its length and its rank among pieces of that length: tasks count their own, and prefix sums over tasks make the counts ranks.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved, table

CAPACITY = 1024
END_ID = 2
#: Words whose ids a task remembers; beyond it the earlier half, with most of the frequent ones, stays.
CACHE = 500_000
_SEGMENT = 1 << 20

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
#: The byte-level vocabulary's word pattern over the characters of _PLAIN, whose classes are the same in every Unicode version.
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞₠-₿]*\Z")
_CUT = re.compile(r"(?<=\S) ")
_tokenizers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenIds:
    """Ids of texts as little-endian 32-bit bytes; words are encoded once and remembered.

    Text outside the plain characters, or that holds a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def segments(self, text: str):
        """Stretches of about _SEGMENT characters, cut before a space after a non-space, where words end in any case."""
        at = 0
        while len(text) - at > _SEGMENT and (m := _CUT.search(text, at + _SEGMENT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [[] for _ in texts]
        held, chars = [], 0
        for i, text in enumerate(texts):
            special = any(s in text for s in self.special)
            for x in self.segments(text):
                if special or not _PLAIN.match(x):
                    out[i].append(np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
                else:
                    out[i].append(b"")
                    held.append((i, len(out[i]) - 1, _WORD.findall(x)))
                    chars += len(x)
                    if chars > _SEGMENT:
                        self.look_up(held, out)
                        held, chars = [], 0
        self.look_up(held, out)
        return [b"".join(x) for x in out]

    def look_up(self, held, out) -> None:
        if len(self.words) > CACHE:
            self.words = dict(itertools.islice(self.words.items(), CACHE // 2))
        new = list(set().union(*(words for *_, words in held)).difference(self.words))
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.words[w] = _packed(e.ids)
        for i, j, words in held:
            out[i][j] = b"".join(map(self.words.__getitem__, words))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_ids(path: str) -> TokenIds:
    if path not in _tokenizers:
        _tokenizers[path] = TokenIds(path)
    return _tokenizers[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces last, a shorter one first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def _pieces(batches, path: str, capacity: int, end_id: int):
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    tokens, end = token_ids(path), np.array([end_id], "<u4").tobytes()
    met = np.zeros(capacity + 1, np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "task", "rank"))])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), tokens.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                ids += end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), task, int(met[length])))
                    met[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        release()


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Places for counts[l] pieces of each length l: rows (length, first rank, first sequence, pieces of it in a row, offset)."""
    left = counts.astype(np.int64).copy()
    groups: list[list] = []  # [sequences, gap, [(length, pieces in a row)]]
    least = capacity // 3 + 1
    for n in range(capacity, least - 1, -1):
        while left[n]:
            fits = np.flatnonzero(left[least : min(n, capacity - n) + 1]) if capacity - n >= least else ()
            partner = least + int(fits[-1]) if len(fits) else 0
            if partner == n and left[n] == 1:
                partner = least + int(fits[-2]) if len(fits) > 1 else 0
            many = int(left[n]) if not partner else int(left[n]) // 2 if partner == n else int(min(left[n], left[partner]))
            items = [(n, 1)] if not partner else [(n, 2)] if partner == n else [(n, 1), (partner, 1)]
            left[n] -= many * (2 if partner == n else 1)
            if partner and partner != n:
                left[partner] -= many
            groups.append([many, capacity - n - partner, items])
    by_gap: dict[int, list[list]] = {}
    for g in groups:
        by_gap.setdefault(g[1], []).append(g)
    for n in range(least - 1, 0, -1):
        while left[n]:
            gap = min((g for g in by_gap if g >= n), default=None)
            if gap is None:
                per = capacity // n
                by_gap.setdefault(capacity, []).append([-(-int(left[n]) // per), capacity, []])
                gap = capacity
            group = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
            per = gap // n
            many = min(group[0], int(left[n]) // per)
            if not many:  # the last few pieces go to one sequence
                many, per = 1, int(left[n])
            if many < group[0]:
                by_gap.setdefault(gap, []).append([group[0] - many, gap, list(group[2])])
            by_gap.setdefault(gap - per * n, []).append([many, gap - per * n, [*group[2], (n, per)]])
            left[n] -= many * per
    rank, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for many, _, items in (g for rest in by_gap.values() for g in rest):
        offset = 0
        for n, per in items:
            rows.append((n, int(rank[n]), sequence, per, offset))
            rank[n] += many * per
            offset += n * per
        sequence += many
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table_[:, 0] << 48) | table_[:, 1], "sequence": table_[:, 2], "per": table_[:, 3], "offset": table_[:, 4], "sequences": np.array([sequence])}


def _place(batches, places):
    for batch in batches:
        length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
        at = np.searchsorted(places["key"], (length << 48) | rank, "right") - 1
        own = rank - (places["key"][at] & ((1 << 48) - 1))
        sequence = places["sequence"][at] + own // places["per"][at]
        offset = places["offset"][at] + own % places["per"][at] * length
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of `docs` (doc_id, text).

    A null or empty text has its end id only.  Null and repeated doc_ids are documents of their own.  An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = saved(rows.mapInArrow(functools.partial(_pieces, path=path or default_tokenizer(), capacity=capacity, end_id=end_id), _PIECES), "pieces")
    counts = saved(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        total[r["length"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(functools.partial(_place, places=plan(total, capacity)), out)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
