"""Operators on hand-made cases, readers and writers on files, models behind fakes, and streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import corpus, detect, evaluate, judge, leakage, preserve
from larkspan.plans import report
from larkspan.plans.notes import notes, predictions
from larkspan.schema import LABELS, SPANS
from larkspan.sources import clients, readers, writers
from larkspan.streaming import detect as stream

D = "/root/testdata/sf0.001"


def pairs_of(spark, cases):
    s = lambda xs: [(a, b, x, "") for a, b, x in xs]
    rows = [(i, "0123456789" * 4, "Low", s(g), s(p)) for i, (g, p) in enumerate(cases)]
    return spark.createDataFrame(rows, f"id int, text string, meta_temp string, gold {SPANS}, predicted {SPANS}")


CASES = [
    ([(0, 4, "PER")], [(0, 4, "PER")], (1, 0, 0), (1, 0, 0)),
    ([(10, 16, "PER")], [(6, 16, "PER")], (0, 1, 1), (1, 0, 0)),
    ([(0, 10, "LOC")], [(5, 15, "LOC")], (0, 1, 1), (1, 0, 0)),
    ([(0, 10, "LOC")], [(6, 16, "LOC")], (0, 1, 1), (0, 1, 1)),
    ([(0, 5, "JOB")], [(0, 5, "EDU")], (0, 1, 1), (0, 1, 1)),
    ([(0, 4, "PER")], [(0, 4, "PER"), (0, 4, "PER")], (1, 0, 0), (1, 1, 0)),
    ([(0, 4, "PER"), (2, 6, "PER")], [(1, 5, "PER")], (0, 1, 2), (1, 0, 1)),
    ([], [], (0, 0, 0), (0, 0, 0)),
]


@pytest.mark.parametrize("case", CASES)
def test_matching_cases(spark, case):
    gold, predicted, strict, relaxed = case
    df = pairs_of(spark, [(gold, predicted)])
    for matching, want in (("strict", strict), ("relaxed", relaxed)):
        r = evaluate.by_label(df, matching).where("label = 'OVERALL'").first()
        assert (r.tp, r.fp, r.fn) == want and (sum(want) or r.f1 == 0.0)


def py_relaxed(gold, predicted):
    used, tp = set(), 0
    for a, b, x in gold:
        best, at = 0.0, None
        for j, (c, d, y) in enumerate(predicted):
            n = min(b, d) - max(a, c)
            r = n / min(b - a, d - c)
            if y == x and j not in used and n > 0 and r >= 0.5 and r > best:
                best, at = r, j
        if at is not None:
            used.add(at)
            tp += 1
    return tp, len(predicted) - tp, len(gold) - tp


def test_relaxed_matching_on_random_spans(spark):
    r = random.Random(8)
    some = lambda: [(a := r.randrange(30), a + r.randint(1, 9), r.choice(["PER", "LOC"])) for _ in range(r.randrange(7))]
    cases = [(some(), some()) for _ in range(150)]
    got = evaluate.outcomes(pairs_of(spark, cases), "relaxed").groupBy("id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]).collect()
    want = {i: py_relaxed(g, p) for i, (g, p) in enumerate(cases) if g or p}
    assert {x.id: (x.tp, x.fp, x.fn) for x in got} == want


def test_miss_taxonomy(spark):
    cases = [([(339, 355, "DATE")], [(346, 355, "DATE")]), ([(250, 265, "JOB")], [(250, 265, "EDU")]), ([(0, 5, "JOB")], [(0, 3, "EDU"), (2, 5, "JOB")]), ([(381, 387, "DATE")], []), ([(5, 8, "PER")], [(0, 5, "PER")]), ([(0, 5, "PER"), (0, 5, "LOC")], [(0, 5, "LOC")])]
    got = {r.id: (r.category, r.fp_labels) for r in evaluate.misses(pairs_of(spark, cases)).collect()}
    assert got == {0: ("boundary", "DATE"), 1: ("label", "EDU"), 2: ("boundary", "EDU|JOB"), 3: ("omission", ""), 4: ("omission", ""), 5: ("omission", "")}


def test_tables_of_facts(spark):
    df = pairs_of(spark, [c[:2] for c in CASES])
    facts = evaluate.facts(df, "a").unionByName(evaluate.facts(df.withColumn("predicted", F.col("gold")), "b")).persist()
    assert facts.where("pipeline = 'b' and label = 'OVERALL' and tier = 'All Categories' and f1 <> 1.0").isEmpty()
    wide = evaluate.side_by_side(facts)
    assert set(wide.columns) == {"tier", "matching", "a", "b"} and "Tier 1" in evaluate.tiers_wide(facts).columns
    text = report.evaluation(facts, "a")
    assert text.startswith("Evaluation of a") and "OVERALL" in text
    with pytest.raises(ValueError):
        report.lines(spark.range(50), "too long", most=10)
    assert evaluate.by_label(df).count() == len(LABELS) + 1
    assert evaluate.token_accuracy(spark.createDataFrame([(["O", None, "B-PER"], ["O", "O", "O"])], "truth array<string>, guess array<string>")).first().accuracy == 0.5


def test_pooled_and_macro_leakage(spark):
    rows = [(1, ["a1", "b1"], "a1"), (2, [f"c{k}" for k in range(8)], "none"), (3, [], "x")]
    df = spark.createDataFrame([(i, "Low", [(0, 1, "PER", t) for t in g], a) for i, g, a in rows], f"id int, meta_temp string, gold {SPANS}, anon string")
    leaks = leakage.entity_leaks(df)
    assert leakage.pooled(leaks).where("label is null and meta_temp is null").first().rate == 0.1
    assert leakage.macro_nonempty(leaks.withColumn("one", F.lit(1)), "one").first().rate == 0.25
    assert round(leakage.macro_all(df, leaks).first().rate, 4) == 0.1667
    assert leakage.docs_with_leaks(leaks).first().docs_leaking == 1
    assert leakage.per_category(leaks).where("id = 1").first().by_label["PER"].leaked == 1
    assert leakage.leak_samples(df).first().surface == "a1"
    seen = spark.createDataFrame([(None, "ab", [(0, 1, "PER", "a")]), ("re", "ab", []), (None, "ab", [])], f"r string, t string, s {SPANS}")
    assert [x.v for x in seen.select(leakage.seen_text(F.col("r"), F.col("t"), F.col("s")).alias("v")).collect()] == ["[PER]b", "re", "ab"]


def test_preservation(spark):
    made = notes(spark, D)
    pairs = evaluate.pair(made, made.select("id", "entities"))
    m = preserve.tagged_metrics(pairs)
    assert m.agg(F.max("levenshtein_masked"), F.max("pii_leaked")).first() == (0.0, 0)
    s = preserve.summarize(m)
    assert s.count() == 4 and preserve.worst_samples(m, "rouge1_full", 6).count() == 6
    rewritten = made.withColumnRenamed("entities", "gold").withColumn("rewritten", F.when(F.col("id") % 2 == 0, F.upper("text")).otherwise(""))
    assert preserve.rewritten_metrics(rewritten).count() == rewritten.where("id % 2 = 0").count()

    def embed():
        import numpy as np

        return lambda texts: [np.array([[1.0, ord(w[0])] for w in t.split()]).reshape(-1, 2) for t in texts]

    got = preserve.embedding_match(spark.createDataFrame([(1, "a b", "a b"), (2, "", "a")], "id int, a string, b string"), "a", "b", embed).collect()
    assert [round(r.f1, 6) for r in got] == [1.0, 0.0]


def test_corpus_operators(spark):
    made = notes(spark, D).withColumn("raw_content", F.lit("Tel mit <PER>Rolf</PER> in <LOC>Bern</LOC>"))
    sizes = {r.split: r["count"] for r in corpus.stratified_split(made).groupBy("split").count().collect()}
    assert sum(sizes.values()) == made.count() and abs(sizes["train"] - made.count() / 2) <= 3
    assert corpus.stratified_sample(made, 10).groupBy("meta_temp").count().agg(F.max("count")).first()[0] == 4
    assert corpus.stratified_sample(made.limit(0), 5).count() == 0
    cases = {"Tel mit <PER>Rolf in Bern": "Unbalanced <PER> tags", "in <GEO>Bern</GEO>": "Invalid tag: <GEO>; Invalid tag: </GEO>", "ok": ""}
    for raw, want in cases.items():
        assert spark.range(1).select(corpus.rule_reasons(F.lit(raw), F.array().cast(SPANS)).alias("v")).first().v == want
    assert spark.range(1).select(corpus.proxy_audit(F.lit("<PER>a <LOC>b</LOC></PER>")).alias("v")).first().v
    tasks = corpus.import_tasks(made).first()
    assert tasks.annotations[0].result[0].value.labels == ["PER"] and len(tasks.annotations[0].result) == 7
    ex = corpus.training_examples(made, "sys").first()
    assert [m.role for m in ex.messages] == ["system", "user", "assistant"] and "@@PER" in ex.messages[2].content
    assert spark.range(1).select(corpus.pad(F.array(F.lit(1)), 3, 0).alias("v")).first().v == [1, 0, 0]
    expected = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    assert [r.ok for r in corpus.verify_expected(expected.withColumn("value", F.lit(1.0)), expected).orderBy("name").collect()] == [True, False]
    ids = spark.createDataFrame([("train", [3, 1, 9999])], "split string, ids array<bigint>")
    assert [r.id for r in corpus.split_records(made, ids).orderBy("pos").collect()] == [3, 1]


def test_detectors(spark):
    made = notes(spark, D)
    found = detect.combine(made, detect.detect_patterns(made), detect.gazetteer({"NATION_1": "LOC"})(made))
    assert found.count() == made.count() and found.where("exists(entities, e -> e.label = 'LOC')").count() > 0

    def load():
        return lambda texts: [[{"start": 0, "end": 3, "label": "B-PERderiv"}, {"start": 4, "end": 7, "label": "MISC"}] if "kunde1" in t else 1 / 0 for t in texts]

    model = detect.model_detector(load, batch=1)(made)
    assert {(e.label, e.text) for r in model.collect() for e in r.entities} == {("PER", "Tel")}
    registry = detect.detect_registry(spark.createDataFrame([(1, "Anna, CEO, 45 Jahre alt, deutsche, Universität Bern, kunde@bank.ch, https://x.ch/a")], "id int, text string")).first()
    assert {(e.label, e.text) for e in registry.entities} >= {("JOB", "CEO"), ("AGE", "45 Jahre alt"), ("NATION", "deutsche"), ("EDU", "Universität Bern"), ("EMAIL", "kunde@bank.ch")}
    assert not any(e.recognizer == "URL" for e in registry.entities)
    boosted = detect.detect_registry(spark.createDataFrame([(1, "Alter: 45, geboren")], "id int, text string"), boost=0.1).first()
    assert {e.score for e in boosted.entities} == {0.9}


def test_models_behind_fakes(spark):
    docs = spark.createDataFrame([(1, "Anna in Bern"), (2, "nichts")], "id int, text string")

    def connect():
        def answer(prompt):
            if prompt.startswith("Is '"):
                return "Ja." if "'Anna'" in prompt else "no"
            return "@@PER Anna## in @@LOC Bern##" if "Anna" in prompt else "nichts"

        return answer

    found = clients.tag_with(connect)(docs).persist()
    assert {r.id: [e.text for e in r.entities] for r in found.collect()} == {1: ["Anna", "Bern"], 2: []}
    kept = clients.verified(found, docs, connect)
    assert {r.id: [e.text for e in r.entities] for r in kept.collect()} == {1: ["Anna"], 2: []}
    calls, waits = [], []

    def flaky(p):
        calls.append(p)
        raise clients.Busy if len(calls) < 3 else ValueError

    assert clients.retrying(flaky, lambda p: f"kept {p}", sleep=waits.append)("x") == "kept x" and waits == [5.0, 10.0] and len(calls) == 3


def test_judging(spark):
    rows = spark.createDataFrame([(1, 7, 8, 1, 9, 9), (2, 8, None, 0, 9, 5), (3, 8, None, 1, 9, 6)], "id int, readability int, meaning int, hallucination int, anonymization_quality int, reidentification_risk int")
    got = {r.score: (r.n, r["mean"], r["std"], r["median"]) for r in judge.score_summary(rows).collect()}
    assert got["readability"] == (3, 7.667, 0.577, 8.0) and got["meaning"] == (1, 8.0, 0.0, 8.0)
    assert judge.hallucination_rate(rows).first().hallucination_rate == 0.333
    attacks = spark.createDataFrame([("p", 1, {"person": "MATCH", "age": "SKIP"}), ("p", 2, {"person": "NO_MATCH", "age": "SKIP"}), ("q", 1, {"person": "SKIP"})], "pipeline string, id int, match map<string,string>")
    s = {r.pipeline: r for r in judge.attack_summary(attacks).collect()}
    assert s["p"].any_leak == 0.5 and s["p"].avg_leak == 0.5 and s["q"].avg_leak is None
    assert judge.document_metrics(attacks, spark.createDataFrame([("p", 1, 0.5)], "pipeline string, id int, rouge1_full double"), spark.createDataFrame([("p", 0.9)], "pipeline string, f1 double")).count() == 3
    assert judge.match_grid(attacks, ["p", "q"]).where("id = 1").first()[1:] == (1, 0)
    log = spark.createDataFrame([("r", e, f) for e, f in enumerate([0.1, 0.5, 0.4, 0.4, 0.4, 0.9])], "run string, epoch int, f1 double")
    assert [r.kept for r in judge.best_so_far(log).orderBy("epoch").collect()] == [True] * 5 + [False]
    assert judge.unjudged(rows, rows.limit(1)).count() == 2
    known = spark.createDataFrame([(1, ["a"], None), (2, None, None)], "id int, person array<string>, age string")
    for c in ("location", "occupation", "education", "nationality"):
        known = known.withColumn(c, F.lit(None).cast("string"))
    assert [r.id for r in judge.attackable(known.withColumn("organization", F.lit(None).cast("array<string>"))).collect()] == [1]


def test_readers_and_writers(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x, ensure_ascii=False))
    put("export.json", [{"id": 1, "text": "Anna", "meta_temp": "Low", "label": [{"start": 2, "end": 4, "text": "na", "labels": ["LOC", "PER"]}, {"start": 0, "end": 1, "text": "A", "labels": ["PER"]}, {"start": 0, "end": 1, "text": "A", "labels": ["MISC"]}, {"start": 0, "end": 1, "text": "A"}]}, {"id": 2, "text": "", "data": {"text": "x"}}])
    got = {r.id: r for r in readers.export(spark, f"{tmp_path}/export.json", ordered=True).collect()}
    assert [e.label for e in got[1].entities] == ["PER", "LOC"] and (got[2].text, got[2].meta_temp, got[2].entities) == ("x", "Unknown", [])
    put("split.json", {"train_ids": [1], "dev_ids": [], "test_ids": [2], "seed": 42, "split": "x"})
    ids = readers.splits(spark, f"{tmp_path}/split.json")
    assert [r.id for r in readers.in_split(readers.export(spark, f"{tmp_path}/export.json"), ids).collect()] == [2]
    put("a_b_predictions.json", [{"id": 1, "entities": [{"start": 0, "end": 4, "label": "PER", "text": "Anna"}]}])
    assert readers.predictions(spark, f"{tmp_path}/a_b_predictions.json").first().pipeline == "a_b"
    put("rewrites.json", [{"id": "7", "rewritten_text": "y"}, {"id": "doc", "rewritten_text": "z"}])
    assert [r.id for r in readers.rewrites(spark, f"{tmp_path}/rewrites.json", "p").collect()] == ["7", "doc"]
    put("p1_attack_scores.json", [{"id": 1, "complexity": "Low", "ground_truth": {"age": 44}, "attacker_guesses": {}, "match": {"age": "MATCH"}}])
    put("p2_attack_scores.json", [{"id": 1, "match": {}}])
    assert sorted(r.pipeline for r in readers.attacks(spark, f"{tmp_path}/*_attack_scores.json").collect()) == ["p1", "p2"]
    put("cache.json", {"5": {"age": "44", "person": ["A"]}})
    assert readers.truth_cache(spark, f"{tmp_path}/cache.json").first().id == 5
    put("eval.json", {"Overall": {"strict": {"All Categories": {"overall": {"precision": 0.5, "recall": 1.0, "f1": 0.6}}}}})
    assert readers.evaluation(spark, f"{tmp_path}/eval.json", "p").first().f1 == 0.6
    assert readers.document_metrics(spark, f"{tmp_path}/missing.json", "p").count() == 0
    misses = evaluate.misses(pairs_of(spark, [([(0, 5, "JOB")], [(0, 3, "EDU")])]))
    writers.misses_csv(misses, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().category == "label"
    writers.array_json(spark.createDataFrame([(1, "ü"), (2, "x")], "id int, t string"), f"{tmp_path}/arr")
    assert json.loads(next((tmp_path / "arr").glob("part*")).read_text()) == [{"id": 1, "t": "ü"}, {"id": 2, "t": "x"}]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "pipeline string, id int")
    writers.json_lines(rows.where("pipeline = 'a'"), f"{tmp_path}/out", by="pipeline")
    assert [r.pipeline for r in writers.missing_pipelines(rows.select("pipeline"), f"{tmp_path}/out").collect()] == ["b"]
    assert writers.missing_pipelines(rows, f"{tmp_path}/none").count() == 2
    writers.append_log(rows, f"{tmp_path}/log"), writers.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4 and "text" not in writers.slim(rows.withColumn("text", F.lit(""))).columns


def test_streams_give_what_batches_give(spark, tmp_path):
    made = notes(spark, D).select("id", "text", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    made.write.json(f"{tmp_path}/in")
    arriving = stream.read_notes(spark, f"{tmp_path}/in")
    stream.write_masked(arriving, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.id: r.masked for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: r.masked for r in stream.masked(made).collect()} and "[IBAN]" in got[1]
    q = stream.label_counts(arriving).writeStream.outputMode("complete").format("memory").queryName("label_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("label_counts").groupBy("label").sum("n").count() == 5


def test_predictions_pair_like_their_notes(spark):
    made = notes(spark, D)
    for e in made.select(F.explode("entities").alias("e"), "text").select(F.expr("substring(text, e.start + 1, e.end - e.start) = e.text").alias("ok")).distinct().collect():
        assert e.ok
    assert evaluate.pair(made, predictions(made).where("id > 5")).where("size(predicted) = 0").count() >= 5


def test_registered_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from larkspan.plans import queries

    con = duckdb.connect()
    for t in ("nation", "customer", "events", "documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    tidy = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    for name in ("strict_by_label", "relaxed_by_label", "misses", "detector_scores", "leakage_pooled", "overlap_longest", "judge_summary", "attack_summary"):
        df = queries.QUERIES[name](spark, D)
        cols = sorted(df.columns)
        cur = con.execute(queries.ORACLE[name])
        at = [[x[0] for x in cur.description].index(c) for c in cols]
        want = sorted((tuple(tidy(r[i]) for i in at) for r in cur.fetchall()), key=str)
        assert sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=str) == want, name
