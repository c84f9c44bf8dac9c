"""Registered queries on sources, sinks and whole chains. Those that write do so to the session's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.functions import text as T
from larkspan.functions.rows import each, spread
from larkspan.operators import corpus, detect, evaluate, judge, leakage, preserve, service
from larkspan.plans import queries as Q
from larkspan.plans.notes import SQL, STRICT, notes, predictions
from larkspan.plans.queries import query
from larkspan.sources import readers, writers

_CAST = 'CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end"'


def _folder(spark: SparkSession) -> str:
    return f"{writers.scratch(spark)}/queries-{uuid.uuid4().hex}"


def _one_text(spark: SparkSession, df: DataFrame, path: str) -> str:
    df.coalesce(1).write.text(path)
    return path


@query(f"{SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 'Unknown' ELSE meta_temp END AS meta_temp, label, {_CAST}, surface FROM gold")
def export_read(spark: SparkSession, d: str) -> DataFrame:
    annotation = lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), F.array(e["label"]).alias("labels"))
    odd = F.when(F.col("id") % 3 == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("Tel").alias("text"), F.array(F.lit("PRODUCT")).alias("labels"))))
    made = notes(spark, d).select("id", "text", F.when(F.col("id") % 4 != 0, F.col("meta_temp")).alias("meta_temp"), F.concat(F.coalesce(odd, F.array().cast("array<struct<start:int,end:int,text:string,labels:array<string>>>")), F.transform("entities", annotation)).alias("label"))
    writers.json_lines(made, path := f"{_folder(spark)}/export")
    read = readers.export(spark, path, ordered=True, lines=True)
    return read.select("id", "meta_temp", F.explode("entities").alias("e")).select("id", "meta_temp", "e.label", "e.start", "e.end", F.col("e.text").alias("surface"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    lists = corpus.stratified_split(notes(spark, d)).groupBy().pivot("split", ["train", "dev", "test"]).agg(F.collect_list("id"))
    path = _one_text(spark, lists.select(F.to_json(F.struct(*[F.col(s).alias(f"{s}_ids") for s in ("train", "dev", "test")], F.lit(42).alias("seed"))).alias("value")), f"{_folder(spark)}/splits")
    return readers.splits(spark, path)


@query(f"{Q._SPLIT} SELECT id, split FROM sp")
def splits_read(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)


@query(f"{Q._SPLIT} SELECT id, text FROM notes JOIN sp USING (id) WHERE split = 'test'")
def test_split_notes(spark: SparkSession, d: str) -> DataFrame:
    return readers.in_split(notes(spark, d), _splits(spark, d)).select("id", "text")


_SOME = STRICT.replace(f"{SQL},", f"{SQL}, pred2 AS (SELECT * FROM pred WHERE id % 10 <> 0),").replace("pred p", "pred2 p")


@query(f"{_SOME}, c AS (SELECT label, {Q._TALLY} FROM out GROUP BY label), f AS (SELECT l.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {Q._labels_sql()} LEFT JOIN c ON c.label = l.label), u AS (SELECT * FROM f UNION ALL SELECT 'OVERALL', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM f) SELECT label, tp, fp, fn, {Q._prf_sql()} FROM u")
def predictions_paired(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    writers.json_lines(predictions(made).where("id % 10 <> 0"), path := f"{_folder(spark)}/predictions")
    return Q._r(evaluate.by_label(evaluate.pair(made, readers.predictions(spark, path, "bent", lines=True))), *Q._PRF)


@query(f"{SQL} SELECT CASE WHEN id % 5 = 0 THEN 'doc-' || id ELSE CAST(id AS VARCHAR) END AS id, text AS rewritten FROM notes")
def rewrites_read(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("id") % 5 == 0, F.concat(F.lit("doc-"), F.col("id").cast("string"))).otherwise(F.lpad(F.col("id").cast("string"), 9, "0"))
    rows = notes(spark, d).select(key.alias("id"), F.col("text").alias("rewritten_text"))
    writers.json_lines(rows, path := f"{_folder(spark)}/rewrites")
    return readers.rewrites(spark, path, "p", lines=True).select("id", "rewritten")


@query(f"{SQL} SELECT id FROM notes WHERE id NOT IN (SELECT n_nationkey FROM nation)")
def truths_cached(spark: SparkSession, d: str) -> DataFrame:
    nations = Q._table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.struct(F.col("n_name").alias("location")).alias("v"))
    one = nations.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    return judge.unjudged(notes(spark, d), readers.truth_cache(spark, _one_text(spark, one, f"{_folder(spark)}/truths"))).select("id")


@query(f"{Q._ATTACK}, n AS (SELECT pipeline, id, CAST(count(*) FILTER (WHERE verdict = 'MATCH') AS INTEGER) AS n_leaked FROM c GROUP BY ALL) SELECT pipeline, id, n_leaked, CASE WHEN pipeline = 'a' AND id % 3 = 0 THEN id / 7.0 END AS rouge1_full, CASE pipeline WHEN 'a' THEN 0.9 END::DOUBLE AS recall FROM n")
def metrics_joined(spark: SparkSession, d: str) -> DataFrame:
    rows = Q._table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") / 7).alias("rouge1_full"))
    where = _folder(spark)
    writers.json_lines(rows, f"{where}/metrics")
    semantic = readers.document_metrics(spark, f"{where}/metrics", "a", lines=True).unionByName(readers.document_metrics(spark, f"{where}/missing", "b"))
    scores = spark.createDataFrame([("a", 0.9)], "pipeline string, recall double")
    return judge.document_metrics(Q._attacks(spark, d), semantic.select("pipeline", "id", "rouge1_full"), scores)


@query(f"{STRICT}, c AS (SELECT label, {Q._TALLY} FROM out GROUP BY label), u AS (SELECT t.tier, {Q._SUMS} FROM {Q._TIERS} LEFT JOIN c ON c.label = t.label GROUP BY 1) SELECT 'p' AS pipeline, 'Overall' AS subset, 'strict' AS matching, tier, {Q._prf_sql()} FROM u")
def evaluation_read(spark: SparkSession, d: str) -> DataFrame:
    cells = evaluate.by_tier(Q._pairs(spark, d)).select("tier", F.struct(F.struct("precision", "recall", "f1").alias("overall")).alias("v"))
    tiers = cells.agg(F.map_from_entries(F.collect_list(F.struct("tier", "v"))).alias("t"))  # a row for each tier
    tree = tiers.select(F.to_json(F.create_map(F.lit("Overall"), F.create_map(F.lit("strict"), F.col("t")))).alias("value"))
    return Q._r(readers.evaluation(spark, _one_text(spark, tree, f"{_folder(spark)}/evaluation"), "p"), *Q._PRF)


@query("WITH l AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS f1 FROM events), b AS (SELECT *, max(f1) OVER w AS best FROM l WINDOW w AS (PARTITION BY run ORDER BY epoch)) SELECT run, CAST(epoch AS INTEGER) AS epoch, f1, best FROM b")
def training_log_read(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    log = Q._table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("epoch"), F.col("value").alias("f1"), F.lit(0.5).alias("loss"))
    where = _folder(spark)
    writers.json_lines(log.where("epoch % 2 = 0"), f"{where}/final")
    writers.json_lines(log.where("epoch % 2 = 1 or epoch % 3 = 0"), f"{where}/live")
    read = judge.best_so_far(readers.training_log(spark, f"{where}/final", f"{where}/live"))
    return read.select(F.col("run").cast("long").alias("run"), "epoch", "f1", "best")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def array_round_trip(spark: SparkSession, d: str) -> DataFrame:
    writers.array_json(Q._table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path := f"{_folder(spark)}/array")
    return spark.read.schema("id bigint, name string").option("multiLine", True).json(path)


@query(f"{SQL} SELECT text, meta_temp, label, {_CAST}, surface FROM gold JOIN notes USING (id, meta_temp)")
def import_tasks_read(spark: SparkSession, d: str) -> DataFrame:
    tasks = corpus.import_tasks(notes(spark, d).withColumn("raw_content", S.tag(F.col("text"), F.col("entities"))))
    writers.json_lines(tasks, path := f"{_folder(spark)}/tasks")
    read = spark.read.schema(tasks.schema).json(path).select("data.text", "data.meta_temp", F.explode(F.col("annotations")[0]["result"]).alias("r"))
    return read.select("text", "meta_temp", F.col("r.value.labels")[0].alias("label"), "r.value.start", "r.value.end", F.col("r.value.text").alias("surface"))


@query(f"{Q._MISSES} SELECT CAST(id AS VARCHAR) AS doc_id, category, label AS gold_label, surface AS gold_text, CAST(start AS INTEGER) AS gold_start, CAST(\"end\" AS INTEGER) AS gold_end, nullif(fp_labels, '') AS overlapping_fp_labels FROM miss")
def misses_written(spark: SparkSession, d: str) -> DataFrame:
    writers.misses_csv(evaluate.misses(Q._pairs(spark, d)), path := f"{_folder(spark)}/misses")
    kinds = "doc_id string, category string, gold_label string, gold_text string, gold_start int, gold_end int, overlapping_fp_labels string, overlapping_fp_texts string"
    return spark.read.schema(kinds).option("header", True).csv(path).drop("overlapping_fp_texts").withColumn("overlapping_fp_labels", F.nullif("overlapping_fp_labels", F.lit("")))


@query("SELECT DISTINCT c_mktsegment AS pipeline FROM customer WHERE c_mktsegment NOT LIKE '%B%'")
def runs_missing(spark: SparkSession, d: str) -> DataFrame:
    wanted = Q._table(spark, d, "customer").select(F.col("c_mktsegment").alias("pipeline")).distinct()
    writers.append_log(wanted.where(F.contains(F.col("pipeline"), F.lit("B"))), path := f"{_folder(spark)}/runs")
    return writers.missing_pipelines(wanted, path)


@query(f"{SQL} SELECT id, meta_temp FROM notes")
def slim_notes(spark: SparkSession, d: str) -> DataFrame:
    return writers.slim(notes(spark, d), "text", "entities")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def attackable_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    people = F.when(k % 3 == 0, F.array("c_name")).otherwise(F.array().cast("array<string>"))
    nothing = [F.lit(None).cast("string").alias(a) for a in ("age", "occupation", "education", "nationality")]
    rows = Q._table(spark, d, "customer").select(k.alias("id"), people.alias("person"), F.when(k % 5 == 0, F.lit("Bern")).alias("location"), *nothing, F.lit(None).cast("array<string>").alias("organization"))
    return judge.attackable(rows).select("id")


@query("WITH w AS (SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS INTEGER) AS n FROM conversations) SELECT conv_id, turn, n, CASE WHEN n < 8 THEN 8 - n ELSE 0 END AS n_padding FROM w WHERE n < 40")
def short_examples(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w))
    rows = corpus.short_enough(Q._table(spark, d, "conversations").withColumn("input_ids", ids), limit=40)
    padded = corpus.pad(F.col("input_ids"), 8, -100)
    return rows.select("conv_id", "turn", F.size("input_ids").alias("n"), F.size(F.filter(padded, lambda x: x == -100)).alias("n_padding"))


@query(f"{Q._ANON} SELECT id, CASE id % 3 WHEN 0 THEN 'new' WHEN 1 THEN anon ELSE text END AS seen FROM anon JOIN notes USING (id, meta_temp)")
def texts_seen(spark: SparkSession, d: str) -> DataFrame:
    rewritten, spans = F.when(F.col("id") % 3 == 0, F.lit("new")), F.when(F.col("id") % 3 == 1, F.col("predicted")).otherwise(S.no_spans())
    return Q._pairs(spark, d).select("id", leakage.seen_text(rewritten, F.col("text"), spans).alias("seen"))


@query(f"{Q._FOUND} SELECT id, label, {_CAST} FROM (SELECT id, label, s, e FROM f UNION ALL SELECT id, label, s, e FROM gold WHERE label = 'LOC')")
def detectors_combined(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    names = {r.n_name: "LOC" for r in Q._table(spark, d, "nation").select("n_name").collect()}  # 25 nations
    found = detect.combine(made, detect.detect_patterns(made), detect.gazetteer(names)(made))
    return found.select("id", each(F.col("entities")).alias("e")).select("id", "e.label", "e.start", "e.end")


# The service's patterns take the comma after an amount with it.
_MASKED = f"{SQL}, m AS (SELECT id, string_agg(CASE WHEN seq = 3 THEN substring(head, 2) ELSE head END || CASE WHEN label = 'PER' THEN surface ELSE '[' || label || ']' END, '' ORDER BY seq) || ', Ende.' AS masked FROM seg GROUP BY id)"


@query(f"{_MASKED} SELECT id, 'cascade' AS pipeline, masked, 6 AS n, 5 AS n_regex, 1 AS n_bert, 0 AS n_llm, CAST(NULL AS VARCHAR) AS error FROM m UNION ALL SELECT -1, 'cascade', NULL, 0, 0, 0, 0, 'empty text'")
def anonymized_by_cascade(spark: SparkSession, d: str) -> DataFrame:
    names = {r.n_name: "LOC" for r in Q._table(spark, d, "nation").select("n_name").collect()}  # 25 nations
    rows = notes(spark, d).select("id", "text").unionByName(spark.createDataFrame([(-1, " ")], "id bigint, text string"))
    out = service.anonymize(rows, "cascade", bert=detect.gazetteer(names))
    return out.select("id", "pipeline", "masked", "n", *[F.col("breakdown")[s].alias(f"n_{s}") for s in service.CASCADE], "error")


@query(Q.ORACLE["detector_scores"])
def baseline_run(spark: SparkSession, d: str) -> DataFrame:
    facts = service.run_baseline(notes(spark, d), lambda docs: detect.detect_patterns(docs, "service"), "patterns", _folder(spark))
    rows = facts.where("subset = 'Overall' and matching = 'strict' and tier = 'All Categories'").select("label", "tp", "fp", "fn", *Q._PRF)
    labels = spark.createDataFrame([(x,) for x in [*Q.LABELS, "OVERALL"]], "label string")
    return Q._r(labels.join(rows, "label", "left").na.fill(0), *Q._PRF)


_CHAIN = "WITH k AS (SELECT c_custkey AS id, c_name, n_name, c_custkey % 4 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT id, CASE WHEN k = 3 THEN false ELSE k <> 1 END AS person, k = 0 OR k = 2 AS location FROM k)"


@query(f"{_CHAIN} SELECT id, person, location, CAST(person AS INTEGER) + CAST(location AS INTEGER) AS leak_count FROM m")
def attacks_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(Q._table(spark, d, "customer"), "c_custkey").join(Q._table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    truth = F.concat(F.lit('Sure: {"person": ["'), F.col("c_name"), F.lit('"], "age": null, "location": "'), F.col("n_name"), F.lit('"} done'))
    # breaks off; the second kind of guess is a placeholder only
    guess = F.concat(F.lit('{"location": "near '), F.lower("n_name"), F.lit('", "person": ["'), F.when(k == 1, F.lit("Herr [PER]")).otherwise(F.lower("c_name")), F.lit('"'))
    verdict = F.when(k == 2, F.lit('{"person": "match"}')).when(k == 1, F.lit('{"location": "NO_MATCH"}')).when(k == 3, F.lit('{"person": "NO_MATCH", "location": "SKIP"')).otherwise(F.lit("no answer"))
    done = service.attack_outcomes(rows.select(F.col("c_custkey").alias("id"), truth.alias("truth_answer"), guess.alias("guess_answer"), verdict.alias("verdict_answer")))
    return done.select("id", F.col("match")["person"].alias("person"), F.col("match")["location"].alias("location"), "leak_count")


@query(f"{SQL} SELECT id, CAST((length(text) + 7) % 10 + 1 AS INTEGER) AS readability, 'fine' AS reason FROM notes")
def judged_by_model(spark: SparkSession, d: str) -> DataFrame:
    def connect():
        def answer(prompt: str) -> str:
            text = prompt.split("\nText: ")[1].split("\nAnonymized: ")[0]
            return f'```json\n{{"readability": {(len(text) + 7) % 10 + 1}, "readability_reason": "fine"}}\n```'

        return answer

    rows = notes(spark, d).select("id", "text", S.anonymize(F.col("text"), F.col("entities")).alias("anon"))
    return service.judge(rows, connect).select("id", "readability", F.col("readability_reason").alias("reason"))


@query(f"{Q._ATTACK} SELECT pipeline, id, attribute, CAST(tier AS INTEGER) AS tier, CASE attribute WHEN 'person' THEN 'a; b' WHEN 'age' THEN '44' END AS truth, CASE attribute WHEN 'age' THEN '44; 45' END AS guesses, verdict FROM c")
def attack_deep_dive(spark: SparkSession, d: str) -> DataFrame:
    truth = F.struct(F.array(F.lit("a"), F.lit("b")).alias("person"), F.lit("44").alias("age"), *[F.lit(None).cast("string").alias(a) for a in ("location", "occupation", "education", "nationality")], F.lit(None).cast("array<string>").alias("organization"))
    guesses = F.create_map(F.lit("age"), F.struct(F.array(F.lit("44"), F.lit("45")).alias("guesses"), F.lit("3").alias("confidence"), F.lit("").alias("reasoning")))
    return service.deep_dive(Q._attacks(spark, d).withColumns({"ground_truth": truth, "attacker_guesses": guesses})).drop("confidence")


@query(f"{Q._ANON}, r AS (SELECT id, count(*) AS total, count(*) FILTER (WHERE leaked) AS leaked, count(*) FILTER (WHERE leaked) * 1.0 / count(*) AS rate FROM leaks GROUP BY 1), a AS (SELECT *, 'highest' AS kind FROM r ORDER BY rate DESC, id LIMIT 5), b AS (SELECT *, 'clean' AS kind FROM r WHERE leaked = 0 ORDER BY md5('42|' || id), id LIMIT 5) SELECT id, total, leaked, round(rate, 6)::DOUBLE AS rate, kind FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def leak_extremes(spark: SparkSession, d: str) -> DataFrame:
    return Q._r(service.leak_extremes(Q._leaks(spark, d)), "rate")


@query(f"{STRICT}, c AS (SELECT label, {Q._TALLY} FROM out GROUP BY label) SELECT round(sum(CASE WHEN tp + fp + fn > 0 THEN tp * 2.0 / (2 * tp + fp + fn) ELSE 0 END * (tp + fn)) / sum(tp + fn), 6)::DOUBLE AS f1, CAST(sum(tp + fn) AS BIGINT) AS support FROM c")
def weighted_f1(spark: SparkSession, d: str) -> DataFrame:
    return Q._r(evaluate.weighted_f1(Q._pairs(spark, d)), "f1")


@query(f"{STRICT}, b AS (SELECT count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome <> 'tp') AS wrong FROM out) SELECT 'bent' AS pipeline, round(tp * 2.0 / (2 * tp + wrong), 6)::DOUBLE AS f1, 2 AS rank FROM b UNION ALL SELECT 'perfect', 1.0, 1")
def pipelines_ranked(spark: SparkSession, d: str) -> DataFrame:
    bent = Q._pairs(spark, d)
    both = evaluate.facts(bent, "bent").unionByName(evaluate.facts(bent.withColumn("predicted", F.col("gold")), "perfect"))
    return Q._r(evaluate.chart_tables(both)["ranking"], "f1")


_GREEDY = """WITH x AS (SELECT user_id AS id, event_id AS k, CAST(event_id * 7 % 97 AS INTEGER) AS s, CAST(event_id * 7 % 97 + 4 + event_id % 9 AS INTEGER) AS e FROM events),
l AS (SELECT id, list({'s': s, 'e': e} ORDER BY k) AS gold, list({'s': s + CAST(k % 5 AS INTEGER) - 2, 'e': e + CAST(k % 3 AS INTEGER)} ORDER BY k) FILTER (WHERE k % 4 <> 0) AS pred FROM x GROUP BY id),
c AS (SELECT id, gold, coalesce(pred, []) AS pred FROM l),
f AS (SELECT id, len(gold) AS n_gold, len(pred) AS n_pred, list_reduce(list_prepend({'s': 0, 'e': 0, 'used': CAST([] AS BIGINT[])}, list_transform(gold, lambda g: {'s': g.s, 'e': g.e, 'used': CAST([] AS BIGINT[])})),
  lambda acc, g: {'s': 0, 'e': 0, 'used': acc.used || list_transform(list_sort(list_filter(list_transform(range(1, len(pred) + 1), lambda j: {'r': (least(g.e, pred[j].e) - greatest(g.s, pred[j].s)) * 1.0 / least(g.e - g.s, pred[j].e - pred[j].s), 'j': -j}), lambda y: y.r >= 0.5 AND NOT list_contains(acc.used, -y.j)), 'DESC')[1:1], lambda y: -y.j)}) AS done FROM c)"""


@query(f"{_GREEDY} SELECT id, CAST(len(done.used) AS INTEGER) AS tp, CAST(n_pred - len(done.used) AS INTEGER) AS fp, CAST(n_gold - len(done.used) AS INTEGER) AS fn FROM f")
def relaxed_contested(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a user's events, crowded into a hundred places, so that most predictions are wanted by several gold spans."""
    k, a = F.col("event_id"), (F.col("event_id") * 7 % 97).cast("int")
    b = a + 4 + (k % 9).cast("int")
    none = F.lit("")
    gold = S.span(a, b, F.lit("PER"), none)
    pred = F.when(k % 4 != 0, S.span(a + (k % 5).cast("int") - 2, b + (k % 3).cast("int"), F.lit("PER"), none))
    rows = Q._table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), gold.alias("g"), pred.alias("p")))).alias("x"))
    pairs = rows.select("id", F.transform("x", lambda x: x["g"]).alias("gold"), F.filter(F.transform("x", lambda x: x["p"]), lambda p: p.isNotNull()).alias("predicted"))
    parts = evaluate.relaxed_parts(F.col("gold"), F.col("predicted"))
    return pairs.select("id", *[F.size(parts[o]).alias(o) for o in ("tp", "fp", "fn")])


# The first 20 strings that survive, with 30 characters on either side of where they first stand in any case.
_SAMPLES = f"{Q._ANON}, h AS (SELECT l.id, l.seq, l.label, l.surface, anon, instr(lower(anon), lower(l.surface)) - 1 AS hit FROM leaks l JOIN anon a USING (id) WHERE leaked ORDER BY l.id, l.seq LIMIT 20)"
Q.ORACLE["leak_samples"] = f"{_SAMPLES} SELECT id, CAST(seq AS INTEGER) AS seq, label, surface, substring(anon, greatest(0, hit - 30) + 1, least(length(anon), hit + length(surface) + 30) - greatest(0, hit - 30)) AS context FROM h"


def _preserved_sql(pair: str) -> str:
    """Metrics and their summary from pair (id, meta_temp, text, changed, mask_a, mask_b, pii_leaked, pii_total)."""
    out = [f"{pair}, base AS (SELECT *, regexp_split_to_array(lower(changed), '\\s+') AS a, regexp_split_to_array(lower(text), '\\s+') AS b FROM pair)"]
    for n in (1, 2, 3, 4):
        gram = " || ' ' || ".join(f"{{0}}[i + {j}]" for j in range(n))
        for s in "ab":
            out.append(f"{s}{n} AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len({s}) - {n} + 2), lambda i: {gram.format(s)})) AS w FROM base) GROUP BY ALL)")
        out.append(f"h{n} AS (SELECT id, sum(least(a{n}.c, b{n}.c)) AS hit FROM a{n} JOIN b{n} USING (id, w) GROUP BY id)")
    joins = " ".join(f"LEFT JOIN h{n} USING (id)" for n in (1, 2, 3, 4))
    logs = " + ".join(f"ln(h{n}.hit * 1.0 / (len(a) - {n - 1}))" for n in (1, 2, 3, 4))
    some = " AND ".join(f"coalesce(h{n}.hit, 0) > 0" for n in (1, 2, 3, 4))
    bleu = f"CASE WHEN {some} THEN CASE WHEN len(a) < len(b) THEN exp(1 - len(b) * 1.0 / len(a)) ELSE 1.0 END * exp(({logs}) / 4) ELSE 0.0 END"
    out.append(f"m AS (SELECT meta_temp, levenshtein(mask_a, mask_b) * 1.0 / greatest(length(mask_a), length(mask_b)) AS levenshtein_masked, coalesce(2.0 * h1.hit / (len(a) + len(b)), 0.0) AS rouge1_full, {bleu} AS bleu4_full, pii_leaked, pii_total FROM base {joins})")
    names = preserve.METRICS
    cells = ", ".join(f"round(avg({n}), 6) AS {n}_mean, round(coalesce(stddev_samp({n}), 0.0), 6) AS {n}_std" for n in names)
    return f"{', '.join(out)} SELECT coalesce(meta_temp, 'Overall') AS subset, count(*) AS n, {cells}, CAST(sum(pii_leaked) AS BIGINT) AS pii_leaked, CAST(sum(pii_total) AS BIGINT) AS pii_total FROM m GROUP BY GROUPING SETS ((), (meta_temp))"


_GOLD_MASKS = "ma AS (SELECT id, string_agg(head || '▮', '' ORDER BY seq) || ', Ende.' AS mask_a FROM seg GROUP BY id)"
Q.ORACLE["text_preservation"] = _preserved_sql(f"{Q._ANON}, {_GOLD_MASKS}, k AS (SELECT id, count(*) AS pii_total, count(*) FILTER (WHERE leaked) AS pii_leaked FROM leaks GROUP BY 1), pair AS (SELECT n.id, n.meta_temp, n.text, anon AS changed, mask_a, regexp_replace(anon, '\\[[A-Z]+\\]', '▮', 'g') AS mask_b, pii_leaked, pii_total FROM notes n JOIN anon USING (id) JOIN ma USING (id) JOIN k USING (id))")
_REWRITTEN = f"{SQL}, rw AS (SELECT id, meta_temp, text, replace(text, 'Limite CHF', 'limite chf') AS changed FROM notes), {_GOLD_MASKS}, k AS (SELECT g.id, count(*) AS pii_total, count(*) FILTER (WHERE regexp_matches(lower(changed), '\\b' || regexp_escape(lower(surface)) || '\\b')) AS pii_leaked FROM gold g JOIN rw USING (id) GROUP BY 1)"
Q.ORACLE["rewritten_preservation"] = _preserved_sql(f"{_REWRITTEN}, pair AS (SELECT rw.*, mask_a, replace(mask_a, 'Limite ', 'limite ') AS mask_b, pii_leaked, pii_total FROM rw JOIN ma USING (id) JOIN k USING (id))")


@query(f"{Q._ATTACK}, q AS (SELECT pipeline, attribute, CAST(tier AS INTEGER) AS tier, round(n_match * 1.0 / (n_match + n_no_match), 3)::DOUBLE AS rate FROM r) SELECT pipeline, attribute, tier, rate FROM q")
def attack_rates_rounded(spark: SparkSession, d: str) -> DataFrame:
    return judge.attribute_rates(Q._attacks(spark, d)).select("pipeline", "attribute", "tier", "rate")


@query(f"{Q._SPLIT}, f AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS pos, text FROM sp JOIN notes USING (id)) SELECT split, CAST(pos AS INTEGER) AS pos, id, text FROM f WHERE id % 8 <> 0")
def split_records(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    ids = corpus.stratified_split(made).groupBy("split").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return corpus.split_records(made.where("id % 8 <> 0"), ids).select("split", "pos", "id", "text")


@query(f"{Q._ANON}, r AS (SELECT id, meta_temp, count(*) FILTER (WHERE leaked) * -1.0 AS score FROM leaks GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY meta_temp ORDER BY score, id) AS n FROM r) SELECT id, meta_temp AS complexity, score::DOUBLE AS score FROM q WHERE n <= 2")
def worst_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = leakage.by_document(Q._leaks(spark, d), "meta_temp").select("id", F.col("meta_temp").alias("complexity"), (-F.col("leaked")).cast("double").alias("score"))
    return preserve.worst_samples(rows, "score").select("id", "complexity", "score")
