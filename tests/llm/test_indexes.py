from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from larkspan.llm import _repeats, _suffix_sort
from larkspan.llm._fm_index import FmIndex, WaveletMatrix
from larkspan.llm._suffix_sort import Suffixes, merge_sort


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 1000)
    c, i = rng.integers(0, 50, 300), rng.integers(0, 1001, 300)
    assert WaveletMatrix(x, 50).rank(c, i).tolist() == [int((x[:b] == a).sum()) for a, b in zip(c, i)]
    assert WaveletMatrix(np.zeros(0, np.int64), 1).rank(np.array([0]), np.array([0])).tolist() == [0]


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 8, 9, 35])
def test_repeated_matches_of_full_length(length):
    rng = np.random.default_rng(length)
    for trial in range(12):
        texts = [rng.integers(1, 4, rng.integers(length, length + 20)) for _ in range(rng.integers(1, 12))]
        if trial % 2 and len(texts) > 1:
            texts[1][:length] = texts[0][:length]
        weight = rng.integers(1, 3, len(texts))
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size + 1) - size - 1
        joined = np.concatenate([np.r_[t, 0] for t in texts])
        count = Counter()
        for t, w in zip(texts, weight.tolist()):
            for k in range(len(t) - length + 1):
                count[tuple(t[k : k + length])] += w
        want = np.zeros(len(joined), bool)
        for t, s in zip(texts, start.tolist()):
            for k in range(len(t) - length + 1):
                want[s + k] = count[tuple(t[k : k + length])] > 1
        got = FmIndex(joined, 4, length).repeated(joined, start, size, np.repeat(weight, size + 1))
        assert got.tolist() == want.tolist()


def _suffixes(n: int) -> tuple[Suffixes, list[bytes]]:
    rng = np.random.default_rng(n)
    data = rng.integers(97, 100, max(n, 1) * 3).astype(np.uint8)
    at = rng.integers(0, len(data), n)
    size = np.minimum(len(data) - at, rng.integers(1, 30, n))
    return Suffixes(data, at, size), [data.tobytes()[a : a + k] for a, k in zip(at.tolist(), size.tolist())]


def _shared(x: bytes, y: bytes) -> int:
    return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 777])
def test_suffixes_in_order(n):
    suffixes, texts = _suffixes(n)
    order, lcp = suffixes.order()
    assert [texts[i] for i in order] == sorted(texts)
    assert lcp.tolist() == [0][:n] + [_shared(texts[a], texts[b]) for a, b in zip(order, order[1:])]


def test_hash_collisions_do_not_mislead_the_sort(monkeypatch):
    monkeypatch.setattr(_suffix_sort, "_VALUES", np.ones(256, np.uint64))  # all bytes alike to the hash
    suffixes, texts = _suffixes(200)
    order, lcp = suffixes.order()
    assert [texts[i] for i in order] == sorted(texts) and lcp.tolist()[1:] == [_shared(texts[a], texts[b]) for a, b in zip(order, order[1:])]


def test_merge_sort_is_stable():
    keys = np.random.default_rng(4).integers(0, 9, 1000)
    assert merge_sort(1000, lambda i, j: keys[i] > keys[j]).tolist() == np.argsort(keys, kind="stable").tolist()


def test_equal_windows_of_periodic_texts():
    texts = [b"x" * 150, b"ab" * 90, b"y" * 20 + b"x" * 130, b"ba" * 60]
    units, spec = _repeats.Units.of_bytes(texts), _repeats.Spec(False, 100, 32, True)
    starts = np.flatnonzero(units.valid(100))
    # each text is one stretch here only where all its windows share one smallest gram
    for k in range(len(texts)):
        one = _repeats.Units.of_bytes(texts[k : k + 1])
        low = _repeats._slide(_repeats.grams(one.hashes(), 32), 69, np.minimum)
        for first, count in zip(*_repeats._runs(low, np.ones(len(low), bool))):
            part = _repeats.Units.of_bytes([texts[k][first : first + count + 99]])
            at = np.flatnonzero(part.valid(100))
            content = [part.buffer[s : s + 100] for s in at]
            assert _repeats._equal_classes(part, spec, at).tolist() == [content.index(c) for c in content]
    assert len(starts)


def test_matching_statistics():
    rng = np.random.default_rng(6)
    for length in (1, 3, 8, 35):
        texts = [rng.integers(1, 3, n) for n in (60, 1, 44, 20)]
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size + 1) - size - 1
        joined = np.concatenate([np.r_[t, 0] for t in texts])
        weight = np.array([1, 2, 1, 1])
        got = FmIndex(joined, 3, length).statistics(joined, start, size, np.repeat(weight, size + 1))
        for t, s in zip(texts, start.tolist()):
            for k in range(len(t)):
                many = lambda n: sum(w * sum(tuple(x[j : j + n]) == tuple(t[k : k + n]) for j in range(len(x) - n + 1)) for x, w in zip(texts, weight.tolist()))
                want = max((n for n in range(1, min(length, len(t) - k) + 1) if many(n) > 1), default=0)
                assert got[s + k] == want
