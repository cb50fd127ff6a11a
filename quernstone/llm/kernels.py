"""NumPy kernels over packed UTF-8 text: word spans, span hashes, lookups.

Texts come as Arrow string columns; their bytes are used in place, in slices of
bounded size, so memory does not grow with the number of rows.  A null text is
a text of no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text worked on at once (or one longer text)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, 1 << 18, 0 if t is None else len(t) * 3 // 2), base, np.uint64)
        t[0] = 1
        _tables[base] = t = np.cumprod(t, dtype=np.uint64)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of the letters of ASCII and of the Latin-1 block (two bytes, the first 0xC3)."""
    low = LOWER[buf]
    second = np.zeros(len(buf), bool)
    second[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[second] += 32
    return low


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most limit bytes, or of one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and text number of every maximal run of non-space bytes."""
    n = len(buf)
    ns = np.zeros(n + 2, bool)
    ns[1 : n + 1] = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    inner = ns[1:]
    before = ns[:-1] & ~first
    starts = np.flatnonzero(inner & ~before)
    ends = np.flatnonzero(ns[:-1] & (~inner | first))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


class Hasher:
    """Hashes of byte spans of one slice by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inverse = _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, tag: int = 0) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + np.uint64((tag * 0xD6E8FEB86659FD93) & (2**64 - 1)))


class Lookup:
    """Positions of hashes in a sorted array of distinct hashes, -1 if absent."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, which): the hashes that are keys, and the keys' numbers."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        pos = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[pos] == h[at]
        return at[ok], pos[ok]
