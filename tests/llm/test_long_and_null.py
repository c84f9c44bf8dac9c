"""Very long texts, crowded strings and tables of nulls, for all ten operators and the stages."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from test_dedup import brute_bytes, brute_words

from larkspan.llm import decontaminate, fingerprints, line_dedup, packing, secrets, simhash_gray, substring_dedup, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def long(spark):
    """Texts of several slices that share long passages, some across the slices' edges."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9)))
    passage, own = [word() for _ in range(400)], [[word() for _ in range(48_000)] for _ in range(2)]
    own[1][43_500:43_900] = passage
    own[0][100:500] = own[0][47_000:47_400] = passage
    texts = [" ".join(own[0]), "  ".join(own[1]), " ".join(own[1][:9000]) + "\n" + " ".join(passage), "w" * 300_000 + " " + " ".join(passage)]
    assert all(len(t) > 1 << 18 for i, t in enumerate(texts) if i != 2)
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), [(i, t) for i, t, *_ in rows]


def test_bytes_of_long_texts(long):
    docs, pairs = long
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got == brute_bytes(pairs, 100) and got[3][1] > 299_000


def test_words_of_long_texts(long):
    docs, pairs = long
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup_words(docs).collect()}
    assert got == brute_words(pairs, 35) and all(x[1] >= 400 for x in got.values())


def test_a_string_with_a_million_places(spark):
    rows = [(1, "q" * 1_000_000), (2, "only here " + "q" * 150 + " and here"), (3, "q" * 99)]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (1_000_000, 999_999), 2: (169, 150), 3: (99, 0)}
    words = [(1, "so so " * 60_000), (2, "a b " + "so " * 40 + "c"), (3, "x y z")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_words(spark.createDataFrame(words, "doc_id bigint, text string")).collect()}
    assert got == {1: (120_000, 120_000), 2: (43, 40), 3: (3, 0)}


def test_the_others_take_long_texts_whole(spark, long):
    docs, pairs = long
    item = " ".join(pairs[0][1].split()[20_000:20_040])
    tests = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id bigint, quality int, toxic int")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, tests).collect()] == [(0, 7)]
    assert {r.n_bytes for r in token_counts.token_counts(docs).collect()} == {len(t) for _, t in pairs}
    assert sum(r.length for r in packing.pack(docs).collect()) == sum({r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()}.values())
    assert simhash_gray.near_duplicates(docs).count() == simhash_gray.one_of_each(docs).count() == 4
    assert fingerprints.edited_fingerprints(docs).count() == secrets.scan(docs).count() == toxicity.toxicity(docs, labels).count() == 4
    assert [r.n_lines for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [1, 1, 2, 1]


def test_nulls_everywhere(spark):
    """A table of null rows is not empty: every operator gives each its row, and the stages keep one or all of them."""
    rows = [(None,) * 5] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(None, None, None)], "doc_id bigint, quality int, toxic int")
    tests = spark.createDataFrame([(None, None)], "item_id bigint, text string")
    for made in (
        simhash_gray.near_duplicates(docs), substring_dedup.dedup_words(docs), secrets.scan(docs), fingerprints.counts_within(fingerprints.edited_fingerprints(docs)), suffix_dedup.dedup_bytes(docs),
        token_counts.token_counts(docs), line_dedup.dedup_lines(docs), packing.pack(docs), toxicity.toxicity(docs, labels), decontaminate.decontaminated(docs, tests), toxicity.clean(docs, labels),
    ):
        assert made.count() == 3
    assert simhash_gray.one_of_each(docs).count() == 1 and decontaminate.contaminated(docs, tests).count() == 0


def test_stages_on_an_empty_table(spark, nothing):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_no_other_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from larkspan.llm import _shared

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda _: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        _shared.shared_dir(session)
