"""Words of whole texts as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text; it never spans two texts.
Null texts count as empty ones.  Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at a time; the power tables have this many entries unless one word is longer.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = mix(np.arange(1, 257, dtype=U64))
_BYTE_LOWER = _BYTE[LOWER]

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, CHUNK), base & (2**64 - 1), U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary column, end to end, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # a column of no chunks
        column = pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one entry more than texts)."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    last[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower`` A-Z count as a-z."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        stop = max(int(np.searchsorted(ends, begin + CHUNK, "right")), at + 1)
        n = int(ends[stop - 1]) - begin
        up, down = _power_tables(n)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(table[data[begin : begin + n]] * up, out=sums[1:])
        s, e = starts[at:stop] - begin, ends[at:stop] - begin
        out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        at = stop
    return out


def words_of(column, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow text column, and for each text the index of its first word (one entry more than texts)."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_bounds(data, offsets)
    return hash_words(data, starts, ends, lower), first


_STEP = 0xD6E8FEB86659FD93


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive words, whatever text they belong to; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out *= U64(_STEP)
        out += words[i : len(words) - n + 1 + i]
    return mix(out)


def slices(first: np.ndarray, words: int):
    """Ranges of whole texts of about so many words together (one longer text makes a range of its own)."""
    at = 0
    while at < len(first) - 1:
        stop = max(int(np.searchsorted(first, first[at] + words, "right")) - 1, at + 1)
        yield at, stop
        at = stop


def distinct_per_text(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs, ordered by text and key."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], text[new]


def shingles_of(column, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n-word shingles of each text, and their text's index, ordered by text and hash.

    A text of fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    words, first = words_of(column, lower)
    keys, owner = [], []
    for a, b in slices(first, 1 << 19):
        w, f = words[first[a] : first[b]], first[a : b + 1] - first[a]
        count = np.diff(f)
        text = np.repeat(np.arange(a, b), np.maximum(count - n + 1, 0))
        at = np.arange(len(text)) + np.repeat(f[:-1] - np.concatenate(([0], np.cumsum(np.maximum(count - n + 1, 0))[:-1])), np.maximum(count - n + 1, 0))
        all_windows = window_hashes(w, n)
        k = all_windows[at] if len(at) else np.zeros(0, U64)
        for size in range(1, n):
            short = np.flatnonzero(count == size)
            if len(short):
                h = np.zeros(len(short), U64)
                for i in range(size):
                    h = h * U64(_STEP) + w[f[short] + i]
                k = np.concatenate((k, mix(h ^ U64(size))))
                text = np.concatenate((text, short + a))
        k, text = distinct_per_text(k, text)
        keys.append(k)
        owner.append(text)
    return (np.concatenate(keys), np.concatenate(owner)) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))
