from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
            assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/decontamination").select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, D)
    assert rows.count() > 0 and "ids_crc32" in rows.columns


def test_queries_are_registered():
    from larkspan.llm import queries

    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]


def test_components_match_union_find(spark):
    import random

    from larkspan.llm._shared import components

    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
