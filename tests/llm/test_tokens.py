from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspan.llm import packing, token_counts

ODD = [
    "", "a  b", "  x", " y ", "a\n b", "a \n b", "<|endoftext|> hi", "Ünïcode ÀÉ İstanbul ſ ß", "日本語 text", "it's we'll 'S x'T", "a\x1cb", "a b 12 345 ²",
    "tab\there \n\n x\r\n y", "Σίσυφος ΟΔΟΣ", "é x", "a \n\n b  ", "\n ", " \n a", "<|startoftext|>a", "x" * 3000, "a b  c", "a  b",
]


def ids(name, texts):
    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, docs, pairs, odd, nothing):
    texts = [*ODD, *(t or "" for _, t in pairs)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df).collect()}
    want = [len(x) for x in ids("word_bpe_49k.json", texts)]
    assert got == {i: (len(t.encode()), n, n > 2048) for i, (t, n) in enumerate(zip(texts, want))}
    assert token_counts.token_counts(odd).count() == 6 and token_counts.token_counts(nothing).count() == 0


def test_ids_equal_the_library(monkeypatch):
    encode = packing.Encoder("byte_bpe_50k.json")
    want = ids("byte_bpe_50k.json", ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(ODD)] == want
    monkeypatch.setattr(packing, "CACHE", 3)  # the cache begins anew all the time
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(ODD)] == want


def test_pieces_cover_each_document_once(docs, pairs):
    rows = packing.pack(docs, ids=True).collect()
    want = {i: [*x, 0] for (i, _), x in zip(pairs, ids("byte_bpe_50k.json", [t or "" for _, t in pairs]))}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r.start)
        assert [x for p in ps for x in p.ids] == want[i] and all(p.doc_tokens == len(want[i]) for p in ps)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) for p in ps)
    assert set(pieces) == set(want)
    padded = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist()
        size = sum(r.length for r in s)
        assert size <= 1024 and all(r.tier == size for r in s)
        padded += size & (size - 1) != 0
    assert padded <= docs.rdd.getNumPartitions()


@pytest.mark.parametrize("seed", range(5))
def test_packer_cuts_exactly(seed):
    rng = np.random.default_rng(seed)
    packer, lengths, out = packing.Packer((8, 16, 32)), {}, []
    for r in range(4):
        now = [(r * 100 + k, int(n)) for k, n in enumerate(rng.integers(1, 90, 30))]
        lengths |= dict(now)
        out += list(packer.round(now))
    out += list(packer.finish())
    seen = {}
    for s in out:
        for n, key, start in s:
            seen.setdefault(key, []).append((start, n))
    for key, ps in seen.items():
        ps.sort()
        assert ps[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ps, ps[1:])) and sum(n for _, n in ps) == lengths[key]
    assert set(seen) == set(lengths) and sum(sum(n for n, *_ in s) not in (8, 16, 32) for s in out) <= 1


def test_packing_of_odd_tables(odd, nothing):
    assert sum(r.length for r in packing.pack(odd).collect() if r.doc_tokens == 1) == 2
    assert packing.pack(nothing).count() == 0


def test_step_groups_are_balanced():
    rng = np.random.default_rng(4)
    steps, seen, groups = packing.StepGroups(64), [], {}
    for last in (False, False, True):
        sequences = []
        for k in range(40):
            size = int(rng.choice([8, 16, 32]))
            parts = np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, size), rng.integers(0, 4), replace=False)), size]).tolist()
            sequences.append([(n, (last, k), 0) for n in parts])
        seen += sequences
        for g, s in steps.deal(sequences, last):
            groups.setdefault(g, []).append(s)
    dealt = [s for x in groups.values() for s in x]
    assert sorted(map(str, dealt)) == sorted(map(str, seen)) and not steps.wait
    length = {g: sum(n for s in x for n, *_ in s) for g, x in groups.items()}
    assert max(length.values()) <= 64
    work = lambda xs: sum(n * n for s in xs for n, *_ in s)
    full = [work(x) for g, x in groups.items() if length[g] == 64]
    naive = [work(seen[a : a + 4]) for a in range(0, len(seen), 4)]
    assert np.std(full) < 0.7 * np.std(naive)
