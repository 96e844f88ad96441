"""Vectorised text scanning over Arrow batches, shared by the corpus operators.

A text column arrives as one contiguous UTF-8 buffer plus offsets; words, lines
and 64-bit hashes are found with numpy over that buffer, so no Python object is
made per word. Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``.
Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _EXACT[LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            steps = np.full(1 << int(n).bit_length(), self.base, np.uint64)
            steps[0] = 1
            self.have = np.cumprod(steps, dtype=np.uint64)
        return self.have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all of its bits can be used."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


class Slab:
    """Some whole texts of a batch: rows lo..hi-1, their bytes, and offsets into them."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, up: Powers, down: Powers):
        self.lo, self.hi, self.data, self.offsets, self.up, self.down = lo, hi, data, offsets, up, down
        self.n = hi - lo
        self._sums: dict[bool, np.ndarray] = {}

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The text, counted from 0 in the slab, that holds each byte position."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and text of each word."""
        full = ~WHITE[self.data]
        first = full.copy()
        first[1:] &= ~full[:-1]
        last = full.copy()
        last[:-1] &= ~full[1:]
        edge = self.offsets[:-1]
        edge = edge[edge < len(full)]
        first[edge] = full[edge]
        if len(edge := self.offsets[1:][self.offsets[1:] > 0]):
            last[edge - 1] = full[edge - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return begin, end, self.doc_of(begin)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last (without the newline), and text of each \\n-split line."""
        breaks = np.flatnonzero(self.data == 10)
        begin = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        doc = np.repeat(np.arange(self.n), 1 + np.bincount(self.doc_of(breaks), minlength=self.n))
        return begin, end, doc

    def hashes(self, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
        """64-bit hashes of byte spans; with ``fold`` A-Z counts as a-z."""
        if fold not in self._sums:
            table = _FOLDED if fold else _EXACT
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(table[self.data] * self.up(len(self.data)), out=sums[1:])
            self._sums[fold] = sums
        sums = self._sums[fold]
        inverse = self.down(len(self.data) + 1)
        return mix((sums[end] - sums[begin]) * inverse[begin])


def slabs(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[Slab]:
    """Cut a string column into runs of whole texts of about ``limit`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    up, down, lo = Powers(_BASE), Powers(_INVERSE), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Slab(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], up, down)
        lo = hi


def pieces_of(column: pa.Array | pa.ChunkedArray, limit: int, long: int) -> Iterator[tuple[Slab, bool, bool]]:
    """As slabs, but a text over ``long`` bytes comes in pieces that end at white space: (slab, is it begun before, does it end here)."""
    for slab in slabs(column, limit):
        size = len(slab.data)
        if slab.n > 1 or size <= long:
            yield slab, False, True
            continue
        lo = 0
        while lo < size:
            hi = min(size, lo + long)
            if hi < size:
                back = np.flatnonzero(WHITE[slab.data[lo + 1 : hi]])
                ahead = back[-1:] + lo + 1 if len(back) else np.flatnonzero(WHITE[slab.data[hi:]])[:1] + hi
                hi = int(ahead[0]) if len(ahead) else size
            yield Slab(slab.lo, slab.hi, slab.data[lo:hi], np.array([0, hi - lo]), slab.up, slab.down), lo > 0, hi == size
            lo = hi


def byte_strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as a binary array."""
    size = end - begin
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(to[-1]) + np.repeat(begin - to[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def chained(h: np.ndarray, size: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` neighbouring words within one text, and where they start."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for k in range(1, size):
        out = out * U64(0x9E3779B97F4A7C15 | 1) + h[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(out[at]), at


def crc32_text(ids) -> np.ndarray:
    """crc32 of each id written as decimal text."""
    import zlib

    return np.fromiter((zlib.crc32(str(x).encode()) for x in ids), np.int64)
