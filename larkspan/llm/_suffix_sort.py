"""Mergesort of suffixes by their bytes; two are compared by prefix hashes and binary search for their common extension."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(977)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
#: Outputs of a merge that are made one after the other; all such chunks of a pass go side by side.
CHUNK = 16


class Suffixes:
    """Suffixes of a buffer, from `at`, of at most `size` bytes each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        self.data, self.at, self.size = data, at, size
        power = np.full(len(data) + 1, _BASE, np.uint64)
        power[:1] = 1
        self.power = np.multiply.accumulate(power)
        self.hash = np.r_[_U(0), np.cumsum(_VALUES[data] * self.power[:-1])]
        self.padded = np.r_[data, np.zeros(1, data.dtype)]
        self.top = 1 << max(0, int(size.max(initial=1)).bit_length() - 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by a binary search over prefix hashes."""
        a, b = self.at[i], self.at[j]
        most = np.minimum(self.size[i], self.size[j])
        swap, have, step = self.power[b], np.zeros(len(a), np.int64), self.top
        scale = self.power[a]
        ha, hb = self.hash[a], self.hash[b]
        while step:
            goal = np.minimum(have + step, most)
            # both sides times the other's power: the hashes then compare without a division
            have = np.where((self.hash[a + goal] - ha) * swap == (self.hash[b + goal] - hb) * scale, goal, have)
            step >>= 1
        return have

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes after suffix j; one that begins the other comes first, equal ones follow neither."""
        n = self.common(i, j)
        x, y = self.padded[self.at[i] + n], self.padded[self.at[j] + n]
        over_i, over_j = n == self.size[i], n == self.size[j]
        return ~over_i & (over_j | (x > y))

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, and each one's common extension with the one before it, verified byte by byte."""
        order = merge_sort(len(self.at), self.after)
        lcp = np.r_[np.zeros(min(1, len(order)), np.int64), self.common(order[1:], order[:-1])]
        if not self._holds(order, lcp):
            order, lcp = self._exact()
        return order, lcp

    def _holds(self, order: np.ndarray, lcp: np.ndarray) -> bool:
        """Whether neighbours share just as many bytes as told and stand in order: no hash has misled the sort."""
        a, b, n = self.at[order[:-1]], self.at[order[1:]], lcp[1:]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (self.data[np.repeat(a, n) + inside] != self.data[np.repeat(b, n) + inside]).any():
            return False
        over = n == self.size[order[:-1]]
        return bool((over | ((n < self.size[order[1:]]) & (self.padded[a + n] < self.padded[b + n]))).all())

    def _exact(self) -> tuple[np.ndarray, np.ndarray]:
        raw = self.data.tobytes()
        texts = [raw[a : a + n] for a, n in zip(self.at.tolist(), self.size.tolist())]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        lcp = [0] * len(order)
        for k in range(1, len(order)):
            x, y = texts[order[k - 1]], texts[order[k]]
            lcp[k] = next((m for m, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return np.array(order, np.int64), np.array(lcp, np.int64)


def merge_sort(n: int, after) -> np.ndarray:
    """Bottom-up stable mergesort of 0..n-1. after(i, j): arrays of numbers -> whether i comes after j.

    A pass merges all pairs of runs at once. Its output is divided into chunks; a binary search along each chunk's
    diagonal finds how much of either run lies before it, then all chunks are merged side by side.
    """
    order, width = np.arange(n), 1
    while width < n:
        chunk = min(2 * width, CHUNK)
        out = np.arange(0, n, chunk)
        base = out // (2 * width) * (2 * width)
        a_end, b_end = np.minimum(base + width, n), np.minimum(base + 2 * width, n)
        diagonal = out - base
        low, high = np.maximum(0, diagonal - (b_end - a_end)), np.minimum(diagonal, a_end - base)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            before = ~after(order[base[open_] + mid], order[a_end[open_] + diagonal[open_] - 1 - mid])
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        i, j = base + low, a_end + diagonal - low
        merged = np.empty_like(order)
        for step in range(chunk):
            live = out + step < b_end
            if not live.all():
                out, i, j, a_end, b_end = out[live], i[live], j[live], a_end[live], b_end[live]
            if not len(out):
                break
            x, y = order[np.minimum(i, n - 1)], order[np.minimum(j, n - 1)]
            both = (i < a_end) & (j < b_end)
            take_b = i >= a_end
            k = np.flatnonzero(both)
            take_b[k] = after(x[k], y[k])
            merged[out + step] = np.where(take_b, y, x)
            i, j = i + ~take_b, j + take_b
        order, width = merged, 2 * width
    return order
