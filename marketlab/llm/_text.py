"""Words, windows and fingerprints of whole Arrow text columns, as NumPy arrays.

Everything here runs inside Spark tasks on slices of about a megabyte, so memory stays bounded
by the slice (or by one document, if that is longer). Fingerprints are 64-bit: two different
word sequences share one with probability 2^-64 for each pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: ASCII white space, the complement of the class [^\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_Q = U64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64, kept for the next slice."""
    if len(_powers.get(base, ())) < n:
        out = np.full((n >> 18) + 1 << 18, base, U64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off.astype(np.int64) - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of about ``limit`` bytes."""
    data, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, min(n, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the documents of one slice."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data, self.off, self.docs = LOWER[data] if lower else data, off, len(off) - 1
        solid = ~SPACE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)  # of each document; one more closes the last
        self.per_doc = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.per_doc)
        self._sum: np.ndarray | None = None

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of byte ranges."""
        if self._sum is None:
            n = len(self.data)
            self._sum = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.data] * _pow(_P, n + 1)[:n], out=self._sum[1:])
        inverse = _pow(pow(_P, -1, 1 << 64), len(self.data) + 1)
        h = (self._sum[end] - self._sum[start]) * inverse[start]
        return mix(h + (end - start).astype(U64) * _Q)

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.start, self.end)

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and fingerprint, of every run of k words of one document."""
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        v = h[:m].copy()
        for j in range(1, k):
            v = v * _Q + h[j : m + j]
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return at, mix(v[at])

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Fingerprints that differ between documents."""
    return h ^ mix(doc.astype(U64) + U64(1))


def twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: does its value occur again, and is this its first place?"""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again, first = np.zeros(len(key), bool), np.ones(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first[order[1:][same]] = False
    return again, first


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges, empty ranges giving 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).astype(np.int64))


class Lookup:
    """A read-only map from 64-bit keys to positions of the arrays it was built from (open addressing)."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(U64)
        self.bits = max(4, int(3 * max(1, len(keys)) // 2).bit_length())
        size = 1 << self.bits
        self.at = np.full(size, -1, np.int32)
        self.keys = np.zeros(size, U64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # the last writer of a slot wins
            won = self.at[slot] == todo
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where absent."""
        slot = self._slot(keys)
        out = self.at[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & (len(self.at) - 1)
            found = self.at[slot]
            out[wrong] = found
            still = (found >= 0) & (self.keys[slot] != keys[wrong])
            wrong, slot = wrong[still], slot[still]
        return out
