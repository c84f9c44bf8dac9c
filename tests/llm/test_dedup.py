from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from larkspan.llm import _repeats, line_dedup, simhash_gray, substring_dedup, suffix_dedup


def brute_bytes(pairs, length):
    seen, out = set(), {}
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(pairs, window):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in pairs}
    count = Counter(tuple(w[s : s + window]) for w in words.values() for s in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "hot"), [(100, 20_000), (100, 1), (17, 20_000)])
def test_bytes_match_brute_force(docs, pairs, length, hot):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_bytes(docs, length, hot=hot).collect()}
    want = brute_bytes(pairs, length)
    assert got == want and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize(("window", "hot"), [(35, 20_000), (35, 1), (8, 20_000)])
def test_words_match_brute_force(docs, pairs, window, hot):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup_words(docs, window, hot=hot).collect()}
    want = brute_words(pairs, window)
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_repeats_of_odd_tables(odd, nothing):
    assert suffix_dedup.dedup_bytes(odd).count() == 6 and suffix_dedup.dedup_bytes(nothing).count() == 0
    got = sorted(suffix_dedup.dedup_bytes(odd, 3, text=True).collect(), key=str)
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 0, 5, 5]  # the row without an id comes first
    assert [r.n_removed for r in substring_dedup.dedup_words(odd, 3).collect() if r.n_words == 3 and r.n_removed] == [3, 3, 3]
    assert substring_dedup.dedup_words(nothing).count() == 0


def test_bytes_of_rows_with_one_id_go_in_the_order_of_their_texts(spark):
    shared = "".join(f"{k:03d}" for k in range(60))
    rows = [(1, "a" + "0" * 90 + shared), (1, "b" + shared), (0, "z" + shared[:120])]
    got = {r.text[:1]: r.n_removed for r in suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), text=True).collect()}
    assert got == {"z": 0, "a": 120, "b": 180}


def test_equal_hashes_are_told_apart():
    units = _repeats.Units.of_bytes([b"abcabcabd", b"abcabd"])
    spec = _repeats.Spec(False, 3, 1, True)
    starts = np.flatnonzero(units.valid(3))
    rep = _repeats._equal_classes(units, spec, starts)
    text = [units.buffer[s : s + 3] for s in starts]
    assert [text.index(t) for t in text] == rep.tolist()
    same, real = np.zeros(1, np.uint64), _repeats.grams
    try:
        _repeats.grams = lambda x, k, which=0: np.repeat(same, max(0, len(x) - k + 1))
        assert [text.index(t) for t in text] == [min(k for k in range(len(rep)) if rep2[k] == r) for rep2 in [_repeats._equal_classes(units, spec, starts)] for r in rep2]
    finally:
        _repeats.grams = real


def fp(text, k=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[s : s + k]), 42) for s in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps: dict, radius: int) -> dict:
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [4096, 2])
def test_near_duplicates_match_brute_force(docs, pairs, limit):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_gray.near_duplicates(docs, limit=limit).collect()}
    fps = {i: fp(t) for i, t in pairs}
    want = groups(fps, 2)
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_links_of_crowded_fingerprints(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1, 1 << 62))
    fps = {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 60, (150, 3))} | {int(x) for x in rng.integers(0, 1 << 62, 100)}
    from larkspan.llm._shared import components

    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    for limit in (4096, 3):
        roots = {r.node: r.root for r in components(simhash_gray.near_links(nodes, 2, limit)).collect()}
        assert {x: roots.get(x, x) for x in fps} == groups({x: x for x in fps}, 2)


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(12) for b in range(a, 12)]))
    codes = codes[np.argsort(simhash_gray._gray_rank(codes))]
    index = simhash_gray.GrayIndex(codes, np.zeros(len(codes), np.int64))
    for r in (0, 1, 2, 5):
        got = {p for i, j in index.links(codes, np.zeros(len(codes), np.int64), r, 7) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for j in range(len(codes)) for i in range(j) if int(codes[i] ^ codes[j]).bit_count() <= r}


def test_near_duplicates_of_odd_tables(odd, nothing):
    rows = simhash_gray.near_duplicates(odd).collect()
    assert len(rows) == 6 and {r.component_id for r in rows if int(r.fingerprint, 16)} == {1, 2}
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert simhash_gray.near_duplicates(nothing).count() == 0


def test_one_of_each_keeps_one_of_near_copies(spark, nothing):
    words = [f"w{k}" for k in range(400)]
    near = words.copy()
    near[200] = "other"
    far = [f"v{k}" if k % 4 == 0 else w for k, w in enumerate(words)]
    rows = [(3, " ".join(words)), (2, " ".join(near)), (5, " ".join(far)), (9, " ".join(words)), (None, " ".join(near)), (7, ""), (8, None)]
    df = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], nothing.schema)
    out = simhash_gray.one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 5, 7]
    assert simhash_gray.one_of_each(nothing).count() == 0


def brute_lines(pairs, gram=2, window=2):
    lines = {i: t.split("\n") for i, t in pairs if t is not None}
    h = {}
    first, places = {}, []
    for i in sorted(lines, key=lambda i: i):
        x = [xxhash.xxh64_intdigest(s.encode(), 42) for s in lines[i]]
        x = [v - (1 << 64) if v >> 63 else v for v in x]
        h[i] = x
        g = [xxhash.xxh64_intdigest(",".join(map(str, x[k : k + gram])).encode(), 42) for k in range(len(x) - gram + 1)]
        g = [v - (1 << 64) if v >> 63 else v for v in g]
        w = min(window, len(g))
        for k in range(len(g)):
            near = [min(g[s : s + w]) for s in range(max(0, k - w + 1), min(k, len(g) - w) + 1)]
            if g[k] in near and any(lines[i][k : k + gram]) and len(x) > 1:
                places.append((g[k], i, k))
                first.setdefault(g[k], (i, k))
    gone = {i: set() for i in lines}
    for g, i, k in places:
        j, m = first[g]
        if (j, m) == (i, k):
            continue
        a, b = k, m
        while a > 0 and b > 0 and h[i][a - 1] == h[j][b - 1]:
            a, b = a - 1, b - 1
        while a < len(h[i]) and b < len(h[j]) and h[i][a] == h[j][b]:
            gone[i].add(a)
            a, b = a + 1, b + 1
    return {i: "\n".join(s for k, s in enumerate(lines[i]) if k not in gone[i]) for i in lines}


def test_lines_match_brute_force(docs, pairs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r.doc_id: r.text for r in out.collect()}
    want = {i: None for i, t in pairs if t is None} | brute_lines(pairs)
    assert got == want and sum(len(got[i] or "") for i in got) < sum(len(t or "") for _, t in pairs)


def test_lines_of_odd_tables(spark, odd, nothing):
    assert line_dedup.dedup_lines(odd).count() == 6 and line_dedup.dedup_lines(nothing).count() == 0
    body = "one\ntwo\nthree"
    df = spark.createDataFrame([(4, body, 1), (1, f"x\n{body}\ny", 2), (None, body, 3), (2, "\n\n\n", 4), (3, "\n\n\n", 5)], "doc_id bigint, text string, n_lines int")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[1].text == f"x\n{body}\ny" and out[4].text == "" and out[None].text == "" and out[3].text == "\n\n\n"
    assert out[4].n_lines == 1 and out[4].n_lines__line == 3 and out[4].n_removed == 3


@pytest.mark.parametrize("links", [250_000, 40])
def test_components_match_brute_force(spark, links):
    from larkspan.llm._shared import components

    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [tuple(map(int, x)) for x in rng.integers(-90, 90, (60, 2))] + [(7, 7), (100, 101)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), links=links).collect()}
    assert {x: got.get(x, x) for x in root} == root
    assert components(spark.createDataFrame([], "u long, v long"), links=links).count() == 0
