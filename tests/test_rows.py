from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan.functions import parse as P
from larkspan.functions import rows as R
from larkspan.functions import spans as S
from larkspan.functions import text as T
from larkspan.operators import evaluate, service
from larkspan.plans import chain_queries, notes, queries

DEALT = [
    "rewritten_preservation",
    "text_preservation",
    "marks_aligned",
    "detector_scores",
    "bleu_of_anonymized",
    "anonymized_by_cascade",
    "iob_round_trip",
    "pipelines_side_by_side",
    "edit_distance_of_anonymized",
    "tags_parsed",
    "detectors_combined",
    "leakage_macro_all",
    "leakage_pooled",
    "leakage_by_tier",
    "cascade_sources",
    "docs_with_leaks",
    "marks_aligned_cursor",
    "marks_aligned_free",
    "attacks_with_fallback",
]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Customers in one row group, as small tables are written."""
    d = str(tmp_path_factory.mktemp("tables"))
    customers = [(k, f"Customer#{k:09}", k % 2, 10.0 * k - 50) for k in range(60)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(0, "KENYA"), (1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    return d


def _made(df) -> int:
    """How often the plan makes a note."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Tel mit ")


def test_each_gives_every_item_and_nothing_of_nothing(spark):
    df = spark.createDataFrame([(1, [3, 3, None]), (2, []), (3, None)], "id int, x array<int>")
    assert [tuple(r) for r in df.select("id", R.each(F.col("x")).alias("v")).collect()] == [(1, 3), (1, 3), (1, None)]
    assert [tuple(r) for r in df.select("id", R.numbered(F.col("x")).alias("n", "v")).collect()] == [(1, 0, 3), (1, 1, 3), (1, 2, None)]


def test_keep_is_a_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, x string")
    assert [tuple(r) for r in R.keep(df, F.col("x") != "").collect()] == [(1, "a")]


def test_notes_are_made_in_many_tasks(spark, tables):
    made = notes.notes(spark, tables)
    assert made.rdd.getNumPartitions() == R.WAVES * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in made.select("id").collect()) == list(range(60))


def test_pattern_detector_makes_each_note_once(spark, tables):
    assert _made(queries.pattern_detector(spark, tables)) == 1


def test_registry_detector_makes_each_note_once(spark, tables):
    assert _made(queries.registry_detector(spark, tables)) == 1


@pytest.mark.parametrize("name", DEALT)
def test_customers_are_dealt_out_wherever_they_are_read(spark, tables, name):
    plan = queries.QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [c_custkey") == plan.count("RepartitionByExpression [c_custkey") > 0


def _once(spark, made) -> bool:
    """Whether the plan works out a text once that a function is given."""
    df = spark.createDataFrame([("ab cd ab",)], "t string").select(made(F.concat("t", F.lit("needle"))).alias("x"))
    df.collect()
    return df._jdf.queryExecution().optimizedPlan().toString().count("needle") == 1


def test_rewritten_preservation_makes_each_note_once(spark, tables):
    assert _made(queries.rewritten_preservation(spark, tables)) == 1


def test_grams_are_clipped(spark):
    """Repeats on both sides, on one, and on none."""
    from collections import Counter

    texts = ["a b a b a c", "a b c d e", "b a b a b", "a a", "x", "c d a b a b"]
    pairs = [(x, y) for x in texts for y in texts]
    df = spark.createDataFrame(pairs, "x string, y string")
    for n in (1, 2, 3):
        split = lambda c: T.ngrams(F.split(c, " "), n)
        got = [r.hit for r in df.select(T._clipped(split("x"), split("y")).alias("hit")).collect()]
        grams = lambda t: Counter(tuple(w[i : i + n]) for w in [t.split()] for i in range(len(w) - n + 1))
        assert got == [sum((grams(x) & grams(y)).values()) for x, y in pairs]


def test_facts_read_the_pairs_once(spark, tables):
    plan = evaluate.facts(queries._pairs(spark, tables), "a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [c_custkey") == 1


def test_marked_entities_make_the_answer_once(spark):
    assert _once(spark, P.marked_entities) and _once(spark, P.loose_marks)


def test_anonymize_makes_each_note_once_a_branch(spark, tables):
    out = service.anonymize(notes.notes(spark, tables), "regex").select("n")
    assert _made(out) == 1


def test_iob_labels_find_the_spans_once(spark):
    spans = lambda t: F.array(S.span(F.lit(0), F.length(t), F.lit("PER"), F.lit("")))
    assert _once(spark, lambda t: S.iob_labels(F.array(F.struct(F.lit(0).alias("start"), F.length(t).alias("end"))), spans(F.lit("x"))))


def test_side_by_side_reads_the_notes_once_a_pipeline(spark, tables):
    plan = queries.pipelines_side_by_side(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [c_custkey") == 2


def test_edit_distance_makes_its_texts_once(spark):
    assert _once(spark, lambda t: T.edit_distance(F.col("t"), t))


def test_tags_are_parsed_from_a_text_made_once(spark):
    assert _once(spark, lambda t: S.parse_tags(t)[1])


def test_detectors_combined_resolve_once(spark, tables):
    assert "size(aggregate" not in chain_queries.detectors_combined(spark, tables)._jdf.queryExecution().optimizedPlan().toString()


def test_leaks_make_each_note_once(spark, tables):
    assert _made(queries.leakage_pooled(spark, tables)) == 1


def test_parts_grow_with_the_table(spark, tables, monkeypatch):
    """A larger table is dealt out to more parts, not to longer ones, and no row is lost."""
    monkeypatch.setattr(R, "PART_BYTES", 20)
    customers = spark.read.parquet(f"{tables}/customer.parquet")
    dealt = notes.notes(spark, tables)
    assert dealt.rdd.getNumPartitions() > R.WAVES * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.select("id").collect()) == list(range(60))
    monkeypatch.setattr(R, "MOST_PARTS", 40)
    assert R.spread(customers, "c_custkey").rdd.getNumPartitions() == 40
    assert R.spread(spark.createDataFrame([(1,)], "c_custkey int"), "c_custkey").rdd.getNumPartitions() == R.WAVES * spark.sparkContext.defaultParallelism


def test_find_scans_a_text_as_re_does(spark):
    """Also for empty matches, at the beginning too, and for texts that hold the sign that texts are cut at."""
    import re

    texts = ["axb", "", "xx", "a\u0000xb", "\u0000", "b$0\\x ax", "häß xéx", "😀x x😀"]
    for p in ("x*", "x", "(?=x)", "(a)?x", r"\bx"):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.find(F.col("t"), p, "PER").alias("e"))
        got = {r.i: [(e.start, e.end, e.text) for e in r.e] for r in df.collect()}
        for i, t in enumerate(texts):
            if p in ("x", r"\bx") or not set(t) & {S.CUT, "😀"}:  # Java finds empty matches within a pair of surrogates
                assert got[i] == [(m.start(), m.end(), m.group()) for m in re.finditer(p, t)], (p, t)
