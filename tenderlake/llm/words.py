"""Word hashes of whole Arrow batches, computed on their bytes without a Python object per word.

A word is a run of bytes of a class; its 64-bit hash is a polynomial over a table of random byte
values, taken from one running sum per chunk, so every position costs the same few vector steps.
The hash depends on the word's bytes alone and is the same in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes hashed at once; the power tables have this length.
CHUNK = 1 << 18
# Text bytes a task works on at once, unless a single text is longer.
PIECE = 1 << 21


def byte_class(pattern_bytes: bytes) -> np.ndarray:
    """A table that is true for the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


# Anything but space and the controls 9 to 13.
NOT_SPACE = ~byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
# ASCII letters, and all bytes of characters beyond ASCII.
LETTERS = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the 256 bytes, powers of an odd base, and their inverses modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    values = np.frombuffer(hashlib.shake_256(b"byte values").digest(256 * 8), dtype=np.uint64)

    def powers(x: int) -> np.ndarray:
        steps = np.full(CHUNK + 1, x, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return values, powers(base), powers(inverse)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes. Spans are ordered by start; a span may share bytes with others."""
    values, power, inverse = _tables()
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        if end[at] - low > CHUNK:  # a single word longer than the tables
            out[at] = int.from_bytes(hashlib.blake2b(data[low : end[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        last = int(np.searchsorted(start, low + CHUNK, side="left"))
        inside = np.flatnonzero(end[at:last] > low + CHUNK)
        last = at + int(inside[0]) if len(inside) else last
        high = int(end[at:last].max())
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(values[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = start[at:last] - low, end[at:last] - low
        out[at:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = last
    return out


class Piece:
    """Some rows of a batch: the bytes of their texts one after the other, and their words."""

    def __init__(self, rows: pa.RecordBatch, text: str, member: np.ndarray):
        self.rows = rows
        column = pc.fill_null(rows.column(text), "")
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        size = int(bounds[-1] - bounds[0]) if len(bounds) else 0
        raw = np.frombuffer(data, dtype=np.uint8, count=size, offset=int(bounds[0])) if size else np.empty(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self.data = LOWER[raw]
        # A word ends at the end of its text too.
        inside = np.zeros(size + 1, dtype=np.int8)
        inside[:-1] = member[self.data]
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        cuts = self.bounds[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < size)])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts - 1] == 1)] if len(cuts) else cuts
        self.start = np.sort(np.concatenate([start, cuts])) if len(cuts) else start
        self.end = np.sort(np.concatenate([end, cuts])) if len(cuts) else end
        self.first = np.searchsorted(self.start, self.bounds)  # of each row, its first word

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def pieces(batches: Iterator[pa.RecordBatch], text: str, member: np.ndarray) -> Iterator[Piece]:
    """Cut batches into pieces of bounded text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = upto[at - 1] if at else 0
            last = max(at + 1, int(np.searchsorted(upto, before + PIECE, side="right")))
            yield Piece(batch.slice(at, last - at), text, member)
            at = last


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes; shorter input gives none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    factor = 1
    for j in range(n):
        total += words[j : j + count] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total)


def shingle_sets(piece: Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each row, sorted, and where each row's begin.

    A text of fewer words has its whole sequence as its one shingle, and one without words none.
    """
    words = piece.hashes()
    count = np.diff(piece.first)
    whole = grams(words, n)
    full = np.maximum(count - n + 1, 0)
    size = np.where((count > 0) & (count < n), 1, full)
    begin = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=begin[1:])
    # Runs that cross into the next row are left out.
    row = piece.row_of_word()[: len(whole)]
    values = np.empty(begin[-1], dtype=np.uint64)
    inside = np.arange(len(whole)) + n <= piece.first[1:][row] if len(whole) else np.empty(0, bool)
    target = np.repeat(size == full, size)
    values[target] = whole[inside]
    for i in np.flatnonzero((count > 0) & (count < n)):
        few = words[piece.first[i] : piece.first[i + 1]]
        values[begin[i]] = grams(few, len(few))[0] ^ np.uint64(len(few))
    for i in np.flatnonzero(size > 1):
        values[begin[i] : begin[i + 1]].sort()
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[begin[:-1][size > 0]] = True
    kept = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(fresh, out=kept[1:])
    return values[fresh], kept[begin]
