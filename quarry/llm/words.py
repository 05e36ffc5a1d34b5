"""64-bit hashes of the words and word shingles of many texts at once.

A word is a longest run of bytes that are not ASCII white space, or not in
another given table; A-Z count as a-z.  A range of bytes b0..bn hashes to b0 + b1 B + b2 B^2 ... modulo 2^64,
which prefix sums give for all ranges, and is then mixed with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.llm.common import slices, text_buffer

SLICE = 250_000  # bytes of text hashed at a time
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE + 2)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n + 1], _powers[1][:n + 1]


class Words:
    """Words of a run of texts: ``text`` (row), ``start``, ``end`` (bytes) and ``hash`` of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True,
                 space: np.ndarray = SPACE) -> None:
        self.data, self.offsets, self.rows = (LOWER[data] if lower else data), offsets, len(offsets) - 1
        n = len(data)
        forward, self._back = _powers_of(n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * forward[:n], out=self._sums[1:])
        visible = ~space[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        opens, closes = visible.copy(), visible.copy()
        if n:
            opens[1:] &= ~visible[:-1] | first[1:n]
            closes[:-1] &= ~visible[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = self.ranges(self.start, self.end)
        self.count = np.bincount(self.text, minlength=self.rows)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        raw = (self._sums[end] - self._sums[start]) * self._back[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of k words of a text; a shorter text is one run of all its words."""
        h, n = self.hash, len(self.hash)
        odd = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) | 1) for j in range(k)]
        at = np.arange(max(0, n - k + 1))
        at = at[self.text[at] == self.text[at + k - 1]] if len(at) else at
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            total += h[at + j] * odd[j]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            first = np.searchsorted(self.text, short)
            part = self.count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            for j in range(k - 1):
                has = self.count[short] > j
                part[has] += h[first[has] + j] * odd[j]
            at, total = np.concatenate([at, first]), np.concatenate([total, part])
            order = np.argsort(at, kind="stable")
            at, total = at[order], total[order]
        return mix(total), at

    def sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of each text, one after another, and the offsets of the texts."""
        hashes, first = self.shingles(k)
        edge = np.searchsorted(self.text[first], np.arange(self.rows + 1)) if len(first) else np.zeros(self.rows + 1, int)
        parts = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def runs_of(column: pa.Array, lower: bool = True, space: np.ndarray = SPACE):
    """Yields (first row, Words) over a column of texts, a bounded run of rows at a time; null is empty."""
    data, offsets = text_buffer(column)
    for low, high in slices(offsets, SLICE):
        yield low, Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower, space)
    pa.default_memory_pool().release_unused()
