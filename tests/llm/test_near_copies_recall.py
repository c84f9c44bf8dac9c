from __future__ import annotations

import random

import numpy as np

from larkspan.llm import simhash_gray


def test_links_are_decided_by_exact_similarity(spark):
    """Pairs a little over and a little under the limit, each pair of words of its own."""
    rows, want = [], set()
    for k in range(240):
        words = [f"p{k}w{j}" for j in range(204)]  # 200 sequences
        new = 19 + k % 8  # the last words of the copy
        copy = words[: 204 - new] + [f"q{k}w{j}" for j in range(new)]
        a, b = (simhash_gray.shingles(" ".join(w).encode()) for w in (words, copy))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k} if len(a & b) / len(a | b) >= 0.8 else {2 * k, 2 * k + 1}
    assert 240 < len(want) < 480
    kept = {r.doc_id for r in simhash_gray.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not want - kept and len(kept - want) <= 6  # no key in common: about 1 % of the pairs at the limit


def _brute(rows, similarity=0.8):
    """Roots by the exact similarity of all pairs."""
    sets = {i: simhash_gray.shingles((t or "").encode()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if len(a & b) >= similarity * len(a | b) - 1e-9 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in ids}


def test_crowded_keys_are_searched_whole(spark):
    """A group of copies some of which are just too far, so that its keys hold many roots, in blocks of one size and of another."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(160):
        own = words.copy()
        for _ in range(r.choice([1, 2, 3, 5, 6])):
            own[r.randrange(150)] = f"x{i}.{r.randrange(9)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    assert 2 < len(want) < 120
    for block in (2048, 7):
        kept = {x.doc_id for x in simhash_gray.one_of_each(df, block=block).collect()}
        assert not want - kept and len(kept - want) <= 2  # a pair at the limit that shares no key


def test_index_passes_over_what_is_linked():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 20, 300, dtype=np.uint64))
    codes = codes[np.argsort(simhash_gray._gray_rank(codes))]
    group, label = np.sort(rng.integers(0, 3, len(codes))), rng.integers(0, 4, len(codes))
    index = simhash_gray.GrayIndex(codes, group, label)
    got = {p for i, j in index.links(codes, np.searchsorted(index.roots, group), 7, 16) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if group[i] == group[j] and label[i] != label[j] and int(codes[i] ^ codes[j]).bit_count() <= 7}
    assert got == want


def test_near_copies_of_a_whole_table(spark):
    """Against the exact similarity of all pairs of a table: none goes without a copy at the limit, hardly one is kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, holders, root = {i: simhash_gray.shingles((t or "").encode()) for i, t in rows}, {}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked, pairs = set(), {}
    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(i)
        for j, both in shared.items():
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                pairs[i, j] = sets[i] == sets[j]
                linked |= {i, j}
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {find(i) for i in root if sets[i]}
    kept = {r.doc_id for r in simhash_gray.one_of_each(docs).collect() if sets[r.doc_id]}
    assert {i for i in sets if sets[i]} - kept <= linked and want <= kept
    assert len(kept - want) <= 0.1 * sum(not same for same in pairs.values()) and not all(pairs.values())
