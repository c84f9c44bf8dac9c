"""The registered queries on the reference operators, each with the SQL that DuckDB checks it by where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import parse as P
from larkspan.functions import spans as S
from larkspan.functions import text as T
from larkspan.functions.rows import each
from larkspan.operators import corpus, detect, evaluate, judge, leakage, preserve
from larkspan.operators.patterns import BASE
from larkspan.plans.notes import SQL, STRICT, notes, predicted
from larkspan.schema import LABELS, TIERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    # predictions come from a note's own columns, so no join is needed to pair them
    return notes(spark, d).select("*", predicted().alias("predicted")).withColumnRenamed("entities", "gold")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _labels_sql() -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ") l(label)"


def _prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    div = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / ({b}), 6) ELSE 0.0 END"
    return f"{div(f'{tp} * 1.0', f'{tp} + {fp}')} AS precision, {div(f'{tp} * 1.0', f'{tp} + {fn}')} AS recall, {div(f'{tp} * 2.0', f'2 * {tp} + {fp} + {fn}')} AS f1"


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_TALLY = ", ".join(f"CAST(count(*) FILTER (WHERE outcome = '{o}') AS BIGINT) AS {o}" for o in ("tp", "fp", "fn"))
_SUMS = ", ".join(f"CAST(coalesce(sum({o}), 0) AS BIGINT) AS {o}" for o in ("tp", "fp", "fn"))
_TIERS = "(VALUES " + ", ".join(f"('Tier {k}', '{x}')" for k, v in TIERS.items() for x in v) + ", " + ", ".join(f"('All Categories', '{x}')" for x in LABELS) + ") t(tier, label)"
_PRF = ("precision", "recall", "f1")


@query(f"{STRICT}, c AS (SELECT label, {_TALLY} FROM out GROUP BY label), f AS (SELECT l.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {_labels_sql()} LEFT JOIN c ON c.label = l.label), u AS (SELECT * FROM f UNION ALL SELECT 'OVERALL', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM f) SELECT label, tp, fp, fn, {_prf_sql()} FROM u")
def strict_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _r(evaluate.by_label(_pairs(spark, d)), *_PRF)


@query(f"{STRICT}, c AS (SELECT label, {_TALLY} FROM out GROUP BY label), u AS (SELECT t.tier, {_SUMS} FROM {_TIERS} LEFT JOIN c ON c.label = t.label GROUP BY 1) SELECT tier, tp, fp, fn, {_prf_sql()} FROM u")
def strict_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return _r(evaluate.by_tier(_pairs(spark, d)), *_PRF)


@query(f"{STRICT}, u AS (SELECT coalesce(meta_temp, 'Overall') AS subset, {_TALLY} FROM out GROUP BY GROUPING SETS ((), (meta_temp))) SELECT subset, tp, fp, fn, {_prf_sql()} FROM u")
def strict_by_subset(spark: SparkSession, d: str) -> DataFrame:
    return _r(evaluate.by_subset(_pairs(spark, d)), *_PRF)


_RELAXED = f"""{SQL}, m AS (SELECT DISTINCT g.id, g.seq, g.label, p.s AS ps, p.e AS pe FROM gold g JOIN pred p ON p.id = g.id AND p.label = g.label AND least(g.e, p.e) - greatest(g.s, p.s) >= 0.5 * least(g.e - g.s, p.e - p.s)),
out AS (SELECT g.label, CASE WHEN m.id IS NULL THEN 'fn' ELSE 'tp' END AS outcome FROM gold g LEFT JOIN m ON m.id = g.id AND m.seq = g.seq
  UNION ALL SELECT p.label, 'fp' FROM pred p LEFT JOIN m ON m.id = p.id AND m.label = p.label AND m.ps = p.s AND m.pe = p.e WHERE m.id IS NULL)"""


@query(f"{_RELAXED}, c AS (SELECT label, {_TALLY} FROM out GROUP BY label), f AS (SELECT l.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {_labels_sql()} LEFT JOIN c ON c.label = l.label), u AS (SELECT * FROM f UNION ALL SELECT 'OVERALL', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM f) SELECT label, tp, fp, fn, {_prf_sql()} FROM u")
def relaxed_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _r(evaluate.by_label(_pairs(spark, d), "relaxed"), *_PRF)


@query(f"{STRICT}, s AS (SELECT label, upper(outcome) AS kind, substring(text, s + 1, e - s) AS surface, count(*) AS n FROM out WHERE outcome <> 'tp' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY n DESC, surface) AS rank FROM s) SELECT label, kind, surface, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25")
def error_ranking(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.error_ranking(_pairs(spark, d))


@query(f"{STRICT}, r AS (SELECT * FROM out WHERE outcome <> 'tp' ORDER BY id, s, e, label, outcome LIMIT 15) SELECT id, outcome, label, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", substring(text, greatest(0, s - 40) + 1, least(length(text), e + 40) - greatest(0, s - 40)) AS context FROM r")
def error_samples(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.error_samples(_pairs(spark, d)).drop("tagged")


@query(f"{STRICT} SELECT id, CAST(count(*) FILTER (WHERE outcome = 'tp') AS INTEGER) AS n_exact, CAST(count(*) FILTER (WHERE outcome = 'fn') AS INTEGER) AS n_missed, CAST(count(*) FILTER (WHERE outcome = 'fp') AS INTEGER) AS n_spurious FROM out GROUP BY id")
def document_log(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.document_log(_pairs(spark, d)).select("id", "n_exact", "n_missed", "n_spurious")


_MISSES = f"""{STRICT}, fn AS (SELECT * FROM out WHERE outcome = 'fn'), fp AS (SELECT * FROM out WHERE outcome = 'fp'),
j AS (SELECT fn.id, fn.label, fn.s, fn.e, fn.text, bool_or(fp.label = fn.label) AS same, count(fp.id) AS n, string_agg(fp.label, '|' ORDER BY fp.s, fp.e, fp.label) AS fp_labels FROM fn LEFT JOIN fp ON fp.id = fn.id AND fn.s < fp.e AND fp.s < fn.e GROUP BY ALL),
miss AS (SELECT id, label, substring(text, s + 1, e - s) AS surface, s AS start, e AS "end", CASE WHEN same THEN 'boundary' WHEN n > 0 THEN 'label' ELSE 'omission' END AS category, coalesce(fp_labels, '') AS fp_labels FROM j)"""


@query(f'{_MISSES} SELECT id, label, surface, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", category, fp_labels FROM miss')
def misses(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.misses(_pairs(spark, d)).drop("fp_texts")


@query(f"{_MISSES}, g AS (SELECT label, count(*) AS gold FROM gold GROUP BY 1), c AS (SELECT label, count(*) FILTER (WHERE category = 'boundary') AS n_boundary, count(*) FILTER (WHERE category = 'label') AS n_label, count(*) FILTER (WHERE category = 'omission') AS n_omission FROM miss GROUP BY 1) SELECT label, gold, coalesce(n_boundary, 0) AS n_boundary, coalesce(n_label, 0) AS n_label, coalesce(n_omission, 0) AS n_omission, round((gold - coalesce(n_boundary + n_label + n_omission, 0)) * 1.0 / gold, 6) AS recall FROM g LEFT JOIN c USING (label)")
def miss_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(evaluate.miss_summary(_pairs(spark, d)), "recall")


@query(f"{_MISSES}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id, start, \"end\", label) AS n FROM miss) SELECT category, id, label, surface, CAST(n AS INTEGER) AS n FROM r WHERE n <= 10")
def miss_examples(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.miss_examples(_pairs(spark, d)).select("category", "id", "label", "surface", "n")


# The base catalogue takes the comma after an amount with it, and finds all other structured spans as they are.
_FOUND = f"{SQL}, f AS (SELECT id, label, s, e + CASE label WHEN 'MONEY' THEN 1 ELSE 0 END AS e FROM gold WHERE label IN ('IBAN', 'EMAIL', 'PHONE', 'DATE', 'MONEY'))"


@query(f"{_FOUND} SELECT id, label, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", substring(text, s + 1, e - s) AS surface FROM f JOIN notes USING (id)")
def pattern_detector(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect_patterns(notes(spark, d))
    return found.select("id", each(F.col("entities")).alias("e")).select("id", "e.label", "e.start", "e.end", F.col("e.text").alias("surface"))


@query(f"{_FOUND}, o AS (SELECT g.label, CASE WHEN f.id IS NULL THEN 'fn' ELSE 'tp' END AS outcome FROM gold g LEFT JOIN f ON f.id = g.id AND f.s = g.s AND f.e = g.e AND f.label = g.label UNION ALL SELECT f.label, 'fp' FROM f LEFT JOIN gold g ON f.id = g.id AND f.s = g.s AND f.e = g.e AND f.label = g.label WHERE g.id IS NULL), c AS (SELECT label, {_TALLY} FROM o GROUP BY label), f2 AS (SELECT l.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {_labels_sql()} LEFT JOIN c ON c.label = l.label), u AS (SELECT * FROM f2 UNION ALL SELECT 'OVERALL', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM f2) SELECT label, tp, fp, fn, {_prf_sql()} FROM u")
def detector_scores(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    own = made.select("id", "text", "meta_temp", F.col("entities").alias("gold"), detect.pattern_spans(F.col("text")).alias("predicted"))
    return _r(evaluate.by_label(own), *_PRF)


@query("WITH m AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS surface FROM documents) SELECT id, surface, count(*) AS n FROM m GROUP BY ALL")
def document_emails(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = docs.select("id", F.explode(S.find(F.col("text"), BASE["EMAIL"][0], "EMAIL")).alias("e"))
    return found.groupBy("id", F.col("e.text").alias("surface")).agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}') AS p, regexp_extract_all(text, '\\btoken = \"[^\"]+\"') AS s FROM documents) SELECT doc_id AS id, CAST(len(p) AS INTEGER) AS n_phone, CAST(len(s) AS INTEGER) AS n_secret FROM x WHERE len(p) + len(s) > 0")
def document_extended(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    kinds = {"n_phone": ("PHONE", -4), "n_secret": ("SECRET", -1)}
    counts = {n: F.size(S.find(F.col("text"), detect.CATALOGUES["extended"][at][1], label)) for n, (label, at) in kinds.items()}
    return docs.select("id", *[c.alias(n) for n, c in counts.items()]).where("n_phone + n_secret > 0")


@query(f"{SQL}, g AS (SELECT s.id, string_agg(head || '[' || label || ']', '' ORDER BY seq) AS t FROM seg s GROUP BY s.id) SELECT id, t || ', Ende.' AS anonymized, regexp_replace(t, '\\[[A-Z]+\\]', '▮', 'g') || ', Ende.' AS masked FROM g")
def placeholders_and_masks(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    anon = S.anonymize(F.col("text"), F.col("entities"))
    return made.select("id", anon.alias("anonymized"), S.mask_placeholders(anon).alias("masked"))


@query(f"{SQL}, g AS (SELECT s.id, string_agg(head || '▮', '' ORDER BY seq) AS t, string_agg(head || '<' || label || '>' || surface || '</' || label || '>', '' ORDER BY seq) AS x, string_agg(head || '@@' || label || ' ' || surface || '##', '' ORDER BY seq) AS m FROM seg s GROUP BY s.id) SELECT id, t || ', Ende.' AS masked, x || ', Ende.' AS tagged, m || ', Ende.' AS marked FROM g")
def masked_tagged_marked(spark: SparkSession, d: str) -> DataFrame:
    t, e = F.col("text"), F.col("entities")
    return notes(spark, d).select("id", S.mask_spans(t, e).alias("masked"), S.tag(t, e).alias("tagged"), S.mark(t, e).alias("marked"))


_GOLD_ROWS = f'{SQL} SELECT id, label, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", surface FROM gold'


def _rows(df: DataFrame, spans) -> DataFrame:
    return df.select("id", each(spans).alias("e")).select("id", "e.label", "e.start", "e.end", F.col("e.text").alias("surface"))


@query(_GOLD_ROWS)
def tags_parsed(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    return _rows(made, S.parse_tags(S.tag(F.col("text"), F.col("entities")))[1])


@query(_GOLD_ROWS)
def marks_aligned(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d).withColumn("m", P.marked_entities(S.mark(F.col("text"), F.col("entities"))))
    return _rows(made, S.align_counts(F.col("text"), F.col("m.entities")))


@query(_GOLD_ROWS)
def marks_aligned_free(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d).withColumn("p", P.loose_marks(S.mark(F.col("text"), F.col("entities"))))
    return _rows(made, S.align_free(F.col("text"), F.col("p")))


@query(_GOLD_ROWS)
def marks_aligned_cursor(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d).withColumn("p", P.loose_marks(S.mark(F.col("text"), F.col("entities")), False))
    return _rows(made, S.align_cursor(F.col("text"), F.col("p")))


@query("WITH r AS (SELECT doc_id AS id, doc_id % 4 AS k FROM labels) SELECT CASE k WHEN 0 THEN 'marked' WHEN 1 THEN 'json_fallback' WHEN 2 THEN 'xml_fallback' ELSE 'failed' END AS method, count(*) AS n, CAST(sum(CASE k WHEN 3 THEN 0 ELSE 1 END) AS BIGINT) AS entities FROM r GROUP BY ALL")
def parse_methods(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, "Herr @@PER Rolf##").when(k == 1, '```json\n[{"text": "Bern", "label": "loc"}]\n```').when(k == 2, "in <LOC>Bern</LOC>").otherwise("Bern")
    rows = _table(spark, d, "labels").select(P.marked_entities(answer).alias("m"))
    return rows.groupBy("m.method").agg(F.count("*").alias("n"), F.sum(F.size("m.entities")).alias("entities"))


_EVENT_SPANS = "WITH x AS (SELECT user_id AS id, event_id AS seq, CAST(event_id * 7 % 97 AS INTEGER) AS s, CAST(event_id * 7 % 97 + 1 + event_id % 9 AS INTEGER) AS e FROM events), l AS (SELECT id, list({'s': s, 'e': e, 'p': (s % 10) / 10.0} ORDER BY s, s - e, seq) AS xs FROM x GROUP BY id)"


def _event_spans(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("event_id") * 7 % 97).cast("int")
    e = S.span(a, a + 1 + (F.col("event_id") % 9).cast("int"), F.lit("PER"), F.lit(""))
    spans = F.transform(F.sort_array(F.collect_list(F.struct("event_id", e.alias("e")))), lambda x: x["e"])
    return _table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(spans.alias("spans"))


@query(f"{_EVENT_SPANS}, k AS (SELECT id, list_reduce(list_transform(xs, lambda z: [z]), lambda acc, z: CASE WHEN z[1].s >= acc[-1].e THEN acc || z ELSE acc END) AS kept FROM l), u AS (SELECT id, unnest(kept) AS z FROM k) SELECT id, z.s AS start, z.e AS \"end\" FROM u")
def overlap_earliest(spark: SparkSession, d: str) -> DataFrame:
    return _event_spans(spark, d).select("id", F.explode(S.resolve_earliest(F.col("spans"))).alias("e")).select("id", "e.start", "e.end")


@query(f"{_EVENT_SPANS.replace('ORDER BY s, s - e, seq', 'ORDER BY s, seq')}, k AS (SELECT id, list_reduce(list_transform(xs, lambda z: [z]), lambda acc, z: CASE WHEN z[1].s >= acc[-1].e THEN acc || z WHEN z[1].e - z[1].s > acc[-1].e - acc[-1].s THEN acc[:-2] || z ELSE acc END) AS kept FROM l), u AS (SELECT id, unnest(kept) AS z FROM k) SELECT id, z.s AS start, z.e AS \"end\" FROM u")
def overlap_longest(spark: SparkSession, d: str) -> DataFrame:
    return _event_spans(spark, d).select("id", F.explode(S.resolve_longest(F.col("spans"))).alias("e")).select("id", "e.start", "e.end")


_HITS = "list_filter(acc, lambda k: least(k.e, z[1].e) - greatest(k.s, z[1].s) > 0.5 * least(k.e - k.s, z[1].e - z[1].s))"


@query(f"{_EVENT_SPANS}, k AS (SELECT id, list_reduce(list_transform(xs, lambda z: [z]), lambda acc, z: CASE WHEN len({_HITS}) = 0 THEN acc || z WHEN z[1].p > {_HITS}[1].p THEN acc[1:list_position(acc, {_HITS}[1]) - 1] || acc[list_position(acc, {_HITS}[1]) + 1:] || z ELSE acc END) AS kept FROM l), u AS (SELECT id, unnest(kept) AS z FROM k) SELECT id, z.s AS start, z.e AS \"end\", CAST(z.p AS DOUBLE) AS score FROM u")
def overlap_scored(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<struct<start:int,end:int,label:string,text:string,score:double>>"
    scored = F.transform("spans", lambda e: F.struct(e["start"], e["end"], e["label"], e["text"], (e["start"] % 10 / 10.0).alias("score"))).cast(kind)
    return _event_spans(spark, d).select("id", F.explode(S.resolve_scored(scored, kind)).alias("e")).select("id", "e.start", "e.end", "e.score")


# Every structured span is found; words before it lift all scores but the amounts' to 1. Of equal bounds the higher one stays.
@query(f"{_FOUND} SELECT id, label, CASE label WHEN 'IBAN' THEN 'IBAN_CODE' WHEN 'EMAIL' THEN 'EMAIL_ADDRESS' WHEN 'PHONE' THEN 'CH_PHONE' WHEN 'DATE' THEN 'DATE_TIME' ELSE label END AS recognizer, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", CASE label WHEN 'MONEY' THEN 0.85 ELSE 1.0 END::DOUBLE AS score FROM f")
def registry_detector(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect_registry(notes(spark, d))
    return found.select("id", each(F.col("entities")).alias("e")).select("id", "e.label", "e.recognizer", "e.start", "e.end", "e.score")


@query(f"{SQL} SELECT source, count(*) AS n FROM (SELECT CASE WHEN label IN ('PER', 'LOC') THEN 'model' ELSE 'patterns' END AS source FROM gold) GROUP BY 1")
def cascade_sources(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    named = made.select("id", F.filter("entities", lambda e: e["label"].isin("PER", "LOC", "DATE")).alias("entities"))
    return detect.source_counts(detect.cascade(made, patterns=detect.detect_patterns(made), model=named))


_ANON = f"""{SQL}, p AS (SELECT id, label, s, e, row_number() OVER (PARTITION BY id ORDER BY s) AS r FROM pred), anon AS (
SELECT n.id, n.meta_temp, string_agg(substring(n.text, coalesce(pe, 0) + 1, s - coalesce(pe, 0)) || '[' || label || ']', '' ORDER BY r) || substring(any_value(n.text), max(e) + 1) AS anon
FROM (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY s) AS pe FROM p) q JOIN notes n USING (id) GROUP BY n.id, n.meta_temp),
leaks AS (SELECT g.id, g.meta_temp, g.seq, g.label, g.surface, regexp_matches(lower(anon), '\\b' || regexp_escape(lower(g.surface)) || '\\b') AS leaked FROM gold g JOIN anon a USING (id))"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.entity_leaks(leakage.anonymized(_pairs(spark, d)))


@query(f"{_ANON} SELECT id, CAST(seq AS INTEGER) AS seq, label, surface, leaked FROM leaks")
def entity_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).drop("meta_temp")


@query(f"{_ANON} SELECT label, meta_temp, count(*) AS total, count(*) FILTER (WHERE leaked) AS leaked, round(count(*) FILTER (WHERE leaked) * 1.0 / count(*), 6) AS rate FROM leaks GROUP BY GROUPING SETS ((), (label), (meta_temp), (label, meta_temp))")
def leakage_pooled(spark: SparkSession, d: str) -> DataFrame:
    return _r(leakage.pooled(_leaks(spark, d)), "rate")


@query(f"{_ANON} SELECT tier, count(*) AS total, count(*) FILTER (WHERE leaked) AS leaked, round(count(*) FILTER (WHERE leaked) * 1.0 / count(*), 6) AS rate FROM leaks JOIN {_TIERS} ON t.label = leaks.label WHERE tier <> 'All Categories' GROUP BY 1")
def leakage_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return _r(leakage.pooled_by_tier(_leaks(spark, d)), "rate")


@query(f"{_ANON}, r AS (SELECT id, meta_temp, avg(CASE WHEN leaked THEN 1.0 ELSE 0.0 END) AS rate FROM leaks GROUP BY ALL) SELECT meta_temp, round(avg(rate), 6) AS rate, count(*) AS n_docs FROM r GROUP BY 1")
def leakage_macro(spark: SparkSession, d: str) -> DataFrame:
    return _r(leakage.macro_nonempty(_leaks(spark, d), "meta_temp"), "rate")


@query(f"{_ANON}, r AS (SELECT n.id, coalesce(count(l.id), 0) AS total, count(*) FILTER (WHERE leaked) AS leaked FROM notes n LEFT JOIN leaks l ON l.id = n.id GROUP BY 1) SELECT round(avg(CASE WHEN total > 0 THEN round(leaked * 1.0 / total, 4) ELSE 0 END), 6) AS rate, count(*) AS n_docs, CAST(sum(total) AS BIGINT) AS total, CAST(sum(leaked) AS BIGINT) AS leaked FROM r")
def leakage_macro_all(spark: SparkSession, d: str) -> DataFrame:
    return _r(leakage.macro_all(notes(spark, d), _leaks(spark, d)), "rate")


@query(f"{_ANON}, r AS (SELECT id, bool_or(leaked) AS hit FROM leaks GROUP BY 1) SELECT count(*) FILTER (WHERE hit) AS docs_leaking, count(*) AS docs, round(count(*) FILTER (WHERE hit) * 1.0 / count(*), 6) AS share FROM r")
def docs_with_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _r(leakage.docs_with_leaks(_leaks(spark, d)), "share")


@query()
def leak_samples(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_samples(leakage.anonymized(_pairs(spark, d)))


_GRAMS = """WITH x AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda z: z <> '') AS a, list_filter(regexp_split_to_array(lower(nxt), '\\s+'), lambda z: z <> '') AS b FROM x WHERE nxt IS NOT NULL),
ga AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(a) AS w FROM p) GROUP BY ALL), gb AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(b) AS w FROM p) GROUP BY ALL), h AS (SELECT conv_id, turn, sum(least(ga.c, gb.c)) AS hit FROM ga JOIN gb USING (conv_id, turn, w) GROUP BY ALL)"""


@query(f"{_GRAMS} SELECT conv_id, turn, round(coalesce(2.0 * hit / (len(a) + len(b)), 0.0), 6) AS rouge1 FROM p LEFT JOIN h USING (conv_id, turn)")
def rouge_of_turns(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    return rows.select("conv_id", "turn", F.round(T.rouge1(F.col("text"), F.col("nxt")), 6).alias("rouge1"))


def _bleu_sql() -> str:
    out = [f"{SQL}, base AS (SELECT n.id, regexp_split_to_array(lower(g.t), '\\s+') AS a, regexp_split_to_array(lower(n.text), '\\s+') AS b FROM notes n JOIN (SELECT id, string_agg(head || CASE WHEN seq % 2 = 0 THEN '[' || label || ']' ELSE surface END, '' ORDER BY seq) || ', Ende.' AS t FROM seg GROUP BY id) g USING (id))"]
    for n in (1, 2, 3, 4):
        gram = " || ' ' || ".join(f"{{0}}[i + {j}]" for j in range(n))
        for s in "ab":
            out.append(f"{s}{n} AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len({s}) - {n} + 2), lambda i: {gram.format(s)})) AS w FROM base) GROUP BY ALL)")
        out.append(f"h{n} AS (SELECT id, sum(least(a{n}.c, b{n}.c)) AS hit FROM a{n} JOIN b{n} USING (id, w) GROUP BY id)")
    joins = " ".join(f"LEFT JOIN h{n} USING (id)" for n in (1, 2, 3, 4))
    logs = " + ".join(f"ln(h{n}.hit * 1.0 / (len(a) - {n - 1}))" for n in (1, 2, 3, 4))
    some = " AND ".join(f"coalesce(h{n}.hit, 0) > 0" for n in (1, 2, 3, 4))
    return f"{', '.join(out)} SELECT id, round(CASE WHEN {some} THEN CASE WHEN len(a) < len(b) THEN exp(1 - len(b) * 1.0 / len(a)) ELSE 1.0 END * exp(({logs}) / 4) ELSE 0.0 END, 6) AS bleu4 FROM base {joins}"


@query(_bleu_sql())
def bleu_of_anonymized(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    half = F.filter("entities", lambda e, i: i % 2 == 0)
    return made.select("id", F.round(T.bleu4(S.anonymize(F.col("text"), half), F.col("text")), 6).alias("bleu4"))


@query(f"{SQL} SELECT n.id, round(levenshtein(n.text, g.t || ', Ende.') * 1.0 / greatest(length(n.text), length(g.t) + 7), 6) AS far FROM notes n JOIN (SELECT id, string_agg(head || '[' || label || ']', '' ORDER BY seq) AS t FROM seg GROUP BY id) g USING (id)")
def edit_distance_of_anonymized(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    return made.select("id", F.round(T.edit_distance(F.col("text"), S.anonymize(F.col("text"), F.col("entities"))), 6).alias("far"))


@query()
def text_preservation(spark: SparkSession, d: str) -> DataFrame:
    return preserve.summarize(preserve.tagged_metrics(_pairs(spark, d)))


@query()
def rewritten_preservation(spark: SparkSession, d: str) -> DataFrame:
    rows = notes(spark, d).withColumnRenamed("entities", "gold").withColumn("rewritten", F.regexp_replace("text", "Limite CHF", "limite chf"))
    return preserve.summarize(preserve.rewritten_metrics(rows))


@query("SELECT round(avg(round((length(text) + 3) * 1.0 / greatest(length(text), 1), 4)), 6) AS length_ratio, count(*) AS n FROM conversations")
def rewrite_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _r(preserve.length_ratio(_table(spark, d, "conversations").withColumn("rewritten", F.concat("text", F.lit("!!!")))), "length_ratio")


_SPLIT = f"{SQL}, o AS (SELECT id, meta_temp, row_number() OVER (PARTITION BY meta_temp ORDER BY md5('42|' || id), id) AS r, count(*) OVER (PARTITION BY meta_temp) AS n FROM notes), sp AS (SELECT id, CASE WHEN r <= floor(n * 0.5) THEN 'train' WHEN r <= floor(n * 0.5) + floor(n * 0.25) THEN 'dev' ELSE 'test' END AS split FROM o)"


@query(f"{_SPLIT} SELECT id, split FROM sp")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stratified_split(notes(spark, d))


@query(f"{SQL}, o AS (SELECT id, meta_temp, row_number() OVER (PARTITION BY meta_temp ORDER BY md5('42|' || id), id) AS r FROM notes) SELECT id, meta_temp FROM o WHERE r <= 33 + CASE meta_temp WHEN 'High' THEN 1 ELSE 0 END")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stratified_sample(notes(spark, d), 100).select("id", "meta_temp")


_FLAT = f"{SQL}, f AS (SELECT id, meta_temp, text, CAST(length(text) AS INTEGER) AS n_chars, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS INTEGER) AS n_words, 7 AS n_entities FROM notes)"


@query(f"{_FLAT}, g AS (SELECT id, string_agg(head || '[' || label || ']', '' ORDER BY seq) || ', Ende.' AS masked FROM seg GROUP BY id) SELECT id, meta_temp, n_chars, n_words, n_entities, CASE WHEN n_chars > 200 THEN left(text, 200) || '…' ELSE text END AS preview, masked, 1 AS \"n_PER\", 0 AS \"n_JOB\" FROM f JOIN g USING (id)")
def flattened_notes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.flatten(notes(spark, d)).select("id", "meta_temp", "n_chars", "n_words", "n_entities", "preview", "masked", "n_PER", "n_JOB")


@query(f"{_SPLIT}, f AS (SELECT id, meta_temp, length(text) AS c FROM notes) SELECT split, count(*) AS n_docs, count(*) FILTER (WHERE meta_temp = 'Low') AS n_low, round(avg(c), 6) AS avg_chars, count(*) * 7 AS n_entities, count(*) AS \"total_PER\" FROM sp JOIN f USING (id) GROUP BY 1")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    out = corpus.split_summary(corpus.flatten(made), corpus.stratified_split(made))
    return _r(out.select("split", "n_docs", "n_low", "avg_chars", "n_entities", "total_PER"), "avg_chars")


@query(f"{_SPLIT} SELECT split, meta_temp, count(*) AS n FROM sp JOIN notes USING (id) GROUP BY CUBE (split, meta_temp)")
def stats_documents(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    return corpus.dataset_stats(made, corpus.stratified_split(made))["docs"]


@query(f"{_SPLIT} SELECT label, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'test') AS test FROM gold JOIN sp USING (id) GROUP BY 1")
def stats_labels(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    return corpus.dataset_stats(made, corpus.stratified_split(made))["labels"]


@query(f"{SQL} SELECT tier, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM gold), 6) AS share FROM gold JOIN {_TIERS} ON t.label = gold.label WHERE tier <> 'All Categories' GROUP BY 1")
def stats_tiers(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    return _r(corpus.dataset_stats(made, corpus.stratified_split(made))["tiers"], "share")


@query("WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS n FROM conversations) SELECT round(avg(n), 6) AS mean_words, CAST(median(n) AS DOUBLE) AS median_words, CAST(min(n) AS INTEGER) AS min_words, CAST(max(n) AS INTEGER) AS max_words FROM w")
def stats_spread(spark: SparkSession, d: str) -> DataFrame:
    w = F.size(T.words(F.col("text")))
    return _r(_table(spark, d, "conversations").agg(F.avg(w).alias("mean_words"), F.median(w).alias("median_words"), F.min(w).alias("min_words"), F.max(w).alias("max_words")), "mean_words")


@query(f"{SQL}, g AS (SELECT coalesce(meta_temp, 'Total') AS level, count(*) AS generated, count(*) FILTER (WHERE id % 6 <> 0) AS retained FROM notes GROUP BY GROUPING SETS ((), (meta_temp))) SELECT level, generated, retained, generated - retained AS rejected, round((generated - retained) * 1.0 / generated, 6) AS rate FROM g")
def rejection_rates(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    return _r(corpus.rejection_rates(made, made.where("id % 6 <> 0")), "rate")


def _raw_notes(spark: SparkSession, d: str) -> DataFrame:
    tagged = S.tag(F.col("text"), F.col("entities"))
    bad = F.when(F.col("id") % 5 == 0, F.replace(tagged, F.lit("</PER>"), F.lit(""))).when(F.col("id") % 7 == 0, F.concat(tagged, F.lit(" in <GEO>Bern</GEO>"))).otherwise(tagged)
    return notes(spark, d).withColumn("raw_content", bad)


_RULES = f"{SQL}, r AS (SELECT id, meta_temp, id % 5 = 0 OR id % 7 = 0 AS bad, id % 9 = 0 AS killed FROM notes)"


@query(f"{SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'Unbalanced <PER> tags' WHEN id % 7 = 0 THEN 'Invalid tag: <GEO>; Invalid tag: </GEO>' ELSE '' END AS reasons FROM notes")
def rule_reasons(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit(_raw_notes(spark, d)).select("id", "reasons")


@query(f"{_RULES} SELECT meta_temp, count(*) AS n_input, count(*) FILTER (WHERE bad) AS n_rules, count(*) FILTER (WHERE NOT bad AND killed) AS n_audit, count(*) FILTER (WHERE NOT bad AND NOT killed) AS n_final FROM r GROUP BY 1")
def audit_stages(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw_notes(spark, d)
    return corpus.stage_counts(raw, raw.where("id % 9 = 0").select("id"))


@query(f"{SQL} SELECT id FROM notes WHERE id % 9 <> 0")
def drop_killed(spark: SparkSession, d: str) -> DataFrame:
    made = notes(spark, d)
    return corpus.drop_killed(made, made.where("id % 9 = 0")).select("id")


@query(f"{SQL}, n2 AS (SELECT id // 10 AS b, id % 10 AS n, text FROM notes), r AS (SELECT printf('doc_%05d', row_number() OVER (ORDER BY b, n)) AS id, text FROM n2) SELECT id, text FROM r")
def generated_batches(spark: SparkSession, d: str) -> DataFrame:
    each = notes(spark, d).select((F.floor(F.col("id") / 10)).alias("batch"), "id", F.concat(F.lit("**Notiz 1:**\n"), S.tag(F.col("text"), F.col("entities"))).alias("t"))
    batches = each.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), f"\n{corpus.SEPARATOR}\n").alias("content")).withColumn("meta_temp", F.lit("Low"))
    return corpus.parse_batches(batches).select("id", "text")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    q, t, k = F.col("quality"), F.col("toxic"), F.col("doc_id")
    body = F.format_string('```json\n{"readability": %d, "meaning": %d, "hallucination": %d, "anonymization_quality": %d, "reidentification_risk": %d, "meaning_reason": "ok"}\n```', q * 9 + 1, k % 14, t, k % 10 + 1, k % 8 + 2)
    loose = F.format_string("readability: %d, meaning = %d; hallucination: %d", k % 12, k % 9 + 1, t)
    return _table(spark, d, "labels").select("doc_id", F.when(k % 4 == 0, loose).when(k % 11 == 0, "").otherwise(body).alias("answer"))


_SCORES = """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN greatest(1, least(10, doc_id % 12)) WHEN doc_id % 11 = 0 THEN NULL ELSE quality * 9 + 1 END AS readability,
CASE WHEN doc_id % 4 = 0 THEN doc_id % 9 + 1 WHEN doc_id % 11 = 0 THEN NULL ELSE greatest(1, least(10, doc_id % 14)) END AS meaning, CASE WHEN doc_id % 4 <> 0 AND doc_id % 11 = 0 THEN NULL ELSE toxic END AS hallucination,
CASE WHEN doc_id % 4 = 0 OR doc_id % 11 = 0 THEN NULL ELSE doc_id % 10 + 1 END AS anonymization_quality, CASE WHEN doc_id % 4 = 0 OR doc_id % 11 = 0 THEN NULL ELSE doc_id % 8 + 2 END AS reidentification_risk FROM labels)"""


@query(f"{_SCORES} SELECT doc_id, " + ", ".join(f"CAST({s} AS INTEGER) AS {s}" for s in P.SCORES) + " FROM s")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("doc_id", P.judge_scores(F.col("answer")).alias("j")).select("doc_id", *[f"j.{s}" for s in P.SCORES])


@query(f"{_SCORES}, u AS (UNPIVOT (SELECT " + ", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in P.SCORES) + f" FROM s) ON {', '.join(P.SCORES)} INTO NAME score VALUE v), m AS (SELECT score, round(avg(v), 3) AS mean, count(*) AS n, round(median(v), 2) AS median FROM u GROUP BY 1) SELECT m.score, m.n, m.mean, m.median, round(sqrt(sum((v - mean) * (v - mean)) / (any_value(m.n) - 1)), 3) AS std FROM u JOIN m ON m.score = u.score GROUP BY m.score, m.n, m.mean, m.median")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return judge.score_summary(judge_scores(spark, d))


def _attacks(spark: SparkSession, d: str) -> DataFrame:
    from larkspan.schema import ATTRIBUTES

    made = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("pipeline"))
    k = F.col("id") * F.when(F.col("pipeline") == "a", 1).otherwise(2)
    pairs = [x for i, a in enumerate(ATTRIBUTES) for x in (F.lit(a), F.when((k + i) % 5 == 0, "MATCH").when((k + i) % 3 == 0, "SKIP").otherwise("NO_MATCH"))]
    return made.select("pipeline", "id", F.create_map(*pairs).alias("match"))


_ATTACK = "WITH a(attribute, i, tier) AS (VALUES ('person', 0, 1), ('age', 1, 3), ('location', 2, 1), ('occupation', 3, 3), ('education', 4, 3), ('nationality', 5, 3), ('organization', 6, 1)), c AS (SELECT p.pipeline, c_custkey AS id, attribute, tier, CASE WHEN (c_custkey * f + i) % 5 = 0 THEN 'MATCH' WHEN (c_custkey * f + i) % 3 = 0 THEN 'SKIP' ELSE 'NO_MATCH' END AS verdict FROM customer, (VALUES ('a', 1), ('b', 2)) p(pipeline, f), a), r AS (SELECT pipeline, attribute, tier, count(*) FILTER (WHERE verdict = 'MATCH') AS n_match, count(*) FILTER (WHERE verdict = 'NO_MATCH') AS n_no_match, count(*) FILTER (WHERE verdict = 'SKIP') AS n_skip FROM c GROUP BY ALL)"


@query(f"{_ATTACK} SELECT pipeline, attribute, CAST(tier AS INTEGER) AS tier, n_match, n_no_match, n_skip, round(n_match * 1.0 / (n_match + n_no_match), 6) AS rate FROM r")
def attack_rates(spark: SparkSession, d: str) -> DataFrame:
    return _r(judge.attribute_rates(_attacks(spark, d), None), "rate")


@query(f"{_ATTACK}, d AS (SELECT pipeline, id, bool_or(verdict = 'MATCH') AS m, bool_or(verdict <> 'SKIP') AS j FROM c GROUP BY ALL), e AS (SELECT pipeline, count(*) AS docs, round(count(*) FILTER (WHERE m) * 1.0 / count(*) FILTER (WHERE j), 6) AS any_leak FROM d GROUP BY 1), q AS (SELECT pipeline, tier, n_match * 1.0 / (n_match + n_no_match) AS rate FROM r) SELECT e.pipeline, docs, any_leak, round(avg(rate), 6) AS avg_leak, round(avg(rate) FILTER (WHERE tier = 1), 6) AS tier1, round(avg(rate) FILTER (WHERE tier = 3), 6) AS tier3 FROM e JOIN q ON q.pipeline = e.pipeline GROUP BY ALL")
def attack_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(judge.attack_summary(_attacks(spark, d), None), "any_leak", "avg_leak", "tier1", "tier3")


@query(f"{_ATTACK} SELECT CAST(tier AS INTEGER) AS tier, attribute, pipeline, count(*) FILTER (WHERE verdict = 'MATCH') AS n_match, count(*) AS n_judged, round(count(*) FILTER (WHERE verdict = 'MATCH') * 1.0 / count(*), 6) AS rate FROM c WHERE verdict <> 'SKIP' GROUP BY ROLLUP (tier, attribute, pipeline)")
def attack_totals(spark: SparkSession, d: str) -> DataFrame:
    return _r(judge.attack_totals(_attacks(spark, d)), "rate")


@query(f"{_ATTACK} SELECT id, CAST(count(*) FILTER (WHERE pipeline = 'a' AND verdict = 'MATCH') AS INTEGER) AS a, CAST(count(*) FILTER (WHERE pipeline = 'b' AND verdict = 'MATCH') AS INTEGER) AS b FROM c GROUP BY 1")
def match_grid(spark: SparkSession, d: str) -> DataFrame:
    return judge.match_grid(_attacks(spark, d), ["a", "b"])


@query("WITH r AS (SELECT doc_id % 5 AS k FROM labels) SELECT CASE WHEN k = 0 THEN 'MATCH' WHEN k IN (1, 2) THEN 'NO_MATCH' ELSE 'SKIP' END AS person, count(*) AS n FROM r GROUP BY 1")
def verdicts_parsed(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ["match", "no match", "Less_Precise", "perhaps", "skip"])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _table(spark, d, "labels").select(P.verdicts(F.concat(F.lit('Sure: {"person": "'), word, F.lit('"}')))["person"].alias("person"))
    return rows.groupBy("person").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT doc_id, doc_id % 4 AS k FROM labels) SELECT doc_id, CASE k WHEN 0 THEN 'Anna|Rolf' WHEN 1 THEN 'Anna' WHEN 2 THEN '' ELSE '' END AS person, CASE k WHEN 3 THEN '44' END AS age FROM r")
def truths_parsed(spark: SparkSession, d: str) -> DataFrame:
    body = F.element_at(F.array(*map(F.lit, ['{"person": ["Anna", " ", "Rolf"], "age": "n/a"}', '{"person": "Anna", "age": null}', '{"person": []}', '{"person": null, "age": "44"}'])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _table(spark, d, "labels").select("doc_id", P.ground_truth(body).alias("t"))
    return rows.select("doc_id", F.coalesce(F.array_join("t.person", "|"), F.lit("")).alias("person"), "t.age")


@query("WITH r AS (SELECT doc_id, doc_id % 5 AS k FROM labels) SELECT doc_id, CASE k WHEN 0 THEN 'a|b|c' WHEN 1 THEN 'Herr Meier' ELSE '' END AS guesses, k = 1 AS matched FROM r")
def guesses_matched(spark: SparkSession, d: str) -> DataFrame:
    body = F.element_at(F.array(*map(F.lit, ['{"person": {"guesses": ["a", "b", "c", "d"]}}', '{"person": {"guesses": ["[PER]", "Herr Meier"], "confidence": 3}}', '{"person": {"guesses": ["Herr [PER]"]}}', '{"person": "x"}', "none"])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _table(spark, d, "labels").select("doc_id", P.sanitize_list(P.guesses(body)["person"]["guesses"]).alias("g"))
    return rows.select("doc_id", F.array_join("g", "|").alias("guesses"), P.matches_any(F.array(F.lit("meier")), F.col("g")).alias("matched"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[1,2]' WHEN 1 THEN '[1]' END AS a FROM labels")
def json_repaired(spark: SparkSession, d: str) -> DataFrame:
    body = F.element_at(F.array(*map(F.lit, ['ok {"a": [1, 2], "b": {"c": "}"', '{"a": [1]} bye', "nothing"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return _table(spark, d, "labels").select("doc_id", F.get_json_object(P.repaired(body), "$.a").alias("a"))


@query("SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'user' ELSE regexp_replace(lower(role), '[^a-z0-9]+', '_', 'g') END AS slug, lower(role || ' x') AS low FROM conversations")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", "role", T.slug(F.col("role")).alias("slug"), F.replace(T.safe_name(F.concat("role", F.lit(" x"))), F.lit("_"), F.lit(" ")).alias("low"))


@query("WITH r AS (SELECT doc_id % 6 AS k FROM labels) SELECT CASE WHEN k IN (0, 1) THEN 'PER' WHEN k IN (2, 3) THEN 'LOC' END AS label, count(*) AS n FROM r GROUP BY 1")
def labels_mapped(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["B-PER", "I-PERderiv", "GPE", "S-loc", "O", "E-MISC"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return _table(spark, d, "labels").select(T.model_label(raw).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"{SQL} SELECT id, label, surface FROM gold WHERE label IN ('PER', 'MONEY', 'PHONE')")
def iob_round_trip(spark: SparkSession, d: str) -> DataFrame:
    some = F.filter("entities", lambda e: e["label"].isin("PER", "MONEY", "PHONE"))
    rows = notes(spark, d).select("id", F.replace("text", F.lit(","), F.lit(" ")).alias("text"), some.alias("e")).withColumn("t", S.tokens(F.col("text")))
    back = S.iob_spans(F.col("text"), F.col("t"), S.iob_labels(F.col("t"), F.col("e")))
    return rows.select("id", F.explode(back).alias("e")).select("id", "e.label", F.col("e.text").alias("surface"))


@query("WITH u AS (SELECT user_id AS job, event_id AS call, value AS tokens FROM events), s AS (SELECT job, call, (tokens * 100 * 1e6 + tokens * 10 * 1e6) / 1e6 AS cost FROM u), r AS (SELECT *, sum(cost) OVER (PARTITION BY job ORDER BY call) AS so_far FROM s) SELECT job, count(*) AS calls FROM r WHERE so_far - cost < 50000 GROUP BY 1")
def capped_cost(spark: SparkSession, d: str) -> DataFrame:
    usage = _table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("call"), (F.col("value") * 100).alias("tokens_in"), (F.col("value") * 10).alias("tokens_out"))
    return judge.running_cost(usage, 1e6, 1e6, 50000.0).groupBy("job").agg(F.count("*").alias("calls"))


@query("WITH r AS (SELECT doc_id, doc_id % 4 AS k, quality FROM labels) SELECT count(*) AS docs, count(*) FILTER (WHERE k = 0) AS n_marked, count(*) FILTER (WHERE k = 3) AS n_failed, round(count(*) FILTER (WHERE k = 3) * 1.0 / count(*), 6) AS fail_rate, round(1 - sum(quality) * 1.0 / sum(quality + 1), 6) AS removal_rate FROM r")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, ["marked", "json_fallback", "xml_fallback", "failed"])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _table(spark, d, "labels").select(method.alias("method"), F.lit(1.0).alias("seconds"), (F.col("quality") + 1).alias("n_before"), F.col("quality").alias("n_after"))
    return _r(judge.run_stats(rows).select("docs", "n_marked", "n_failed", "fail_rate", "removal_rate"), "fail_rate", "removal_rate")


@query(f"{STRICT}, c AS (SELECT count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM out) SELECT 'All Categories' AS tier, 'strict' AS matching, round(tp * 2.0 / (2 * tp + fp + fn), 6) AS bent, 1.0::DOUBLE AS perfect FROM c")
def pipelines_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    bent = _pairs(spark, d)
    both = evaluate.facts(bent, "bent").unionByName(evaluate.facts(bent.withColumn("predicted", F.col("gold")), "perfect"))
    wide = evaluate.side_by_side(both, ["bent", "perfect"]).where("tier = 'All Categories' and matching = 'strict'")
    return _r(wide.select("tier", "matching", "bent", "perfect"), "bent")


@query(f"{SQL} SELECT subset, name, n FROM (SELECT coalesce(meta_temp, 'Overall') AS subset, CAST(count(*) AS BIGINT) AS notes, CAST(sum(length(text)) AS BIGINT) AS chars FROM notes GROUP BY GROUPING SETS ((), (meta_temp))) UNPIVOT (n FOR name IN (notes, chars))")
def unpivoted(spark: SparkSession, d: str) -> DataFrame:
    wide = notes(spark, d).select(F.explode(F.array(F.lit("Overall"), "meta_temp")).alias("subset"), F.length("text").alias("c")).groupBy("subset").agg(F.count("*").alias("notes"), F.sum("c").alias("chars"))
    return wide.unpivot("subset", ["notes", "chars"], "name", "n")


@query(f"{SQL} SELECT id, text FROM notes ORDER BY id LIMIT 25")
def first_notes(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("id", "text").orderBy("id").limit(25)

