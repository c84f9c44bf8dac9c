"""Whole chains: anonymizing by a named pipeline, running and evaluating a detector, judging, and attacking anonymized texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import parse as P
from larkspan.functions import spans as S
from larkspan.functions.rows import keep
from larkspan.operators import detect, evaluate, leakage
from larkspan.schema import ATTRIBUTES, LIST_ATTRIBUTES, SPANS
from larkspan.sources import clients, writers

SOURCED = SPANS.replace("text:string", "text:string,source:string")
#: The stages of the cascade, in order.
CASCADE = ("regex", "bert", "llm")


def pipelines(**models: detect.Detector) -> dict[str, detect.Detector]:
    """Detectors by name: the service's patterns, the registry, the models given (bert, llm, ...), and the cascade of those of
    regex, bert and llm that there are. A model named rewrite gives (id, rewritten) instead of spans."""
    out: dict[str, detect.Detector] = {"regex": lambda docs: detect.detect_patterns(docs, "service"), "registry": detect.detect_registry, **models}
    stages = [name for name in CASCADE if name in out]
    return out | {"cascade": lambda docs: detect.cascade(docs, **{name: out[name](docs) for name in stages})}


def anonymize(docs: DataFrame, pipeline: str, **models: detect.Detector) -> DataFrame:
    """(id, text, ...) -> (id, pipeline, entities, masked, n, breakdown, rewritten, error), one row per document.

    A tagging pipeline fills entities (with their stage as source, in the cascade), masked (placeholders for them), n and, for
    the cascade, breakdown: spans by stage. A rewriting one fills rewritten. Blank and null texts have the error "empty text".
    """
    known = pipelines(**models)
    if pipeline not in known:
        raise ValueError(f"unknown pipeline '{pipeline}'")
    rows = docs.select("id", S.strip(F.coalesce("text", F.lit(""))).alias("text"))
    error = F.when(F.col("text") == "", "empty text")
    found = known[pipeline](keep(rows, F.col("text") != ""))
    name = F.lit(pipeline).alias("pipeline")
    if "rewritten" in found.columns:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("entities", f"{SOURCED}"), ("masked", "string"), ("n", "int"), ("breakdown", "map<string,int>"))]
        return rows.join(found.select("id", "rewritten"), "id", "left").select("id", name, *none, "rewritten", error.alias("error"))
    source = (lambda e: e["source"]) if pipeline == "cascade" else lambda _: F.lit(None).cast("string")
    spans = F.transform(F.coalesce(F.col("entities"), F.array().cast(dict(found.dtypes)["entities"])), lambda e: F.struct(e["start"], e["end"], e["label"], e["text"], source(e).alias("source"))).cast(SOURCED)
    out = rows.join(found.select("id", "entities"), "id", "left").withColumn("entities", spans)
    count = lambda s: F.size(F.filter("entities", lambda e: e["source"] == s))
    parts = F.map_from_arrays(F.array(*map(F.lit, CASCADE)), F.array(*map(count, CASCADE))) if pipeline == "cascade" else F.lit(None).cast("map<string,int>")
    masked = S.anonymize(F.col("text"), F.transform("entities", lambda e: S.span(e["start"], e["end"], e["label"], e["text"])).cast(SPANS))
    return out.select("id", name, "entities", F.when(error.isNull(), masked).alias("masked"), F.size("entities").alias("n"), parts.alias("breakdown"), F.lit(None).cast("string").alias("rewritten"), error.alias("error"))


def run_baseline(gold: DataFrame, detector: detect.Detector, name: str, path: str) -> DataFrame:
    """Detects in gold's texts (id, text, meta_temp, entities), evaluates and writes the run under path/name: predictions,
    facts, error_samples, error_ranking and document_log. Gives the facts, as written."""
    where = f"{path}/{name}"
    writers.json_lines(detector(gold.select("id", "text")).select("id", F.col("entities").cast(SPANS).alias("entities")), f"{where}/predictions")
    read = gold.sparkSession.read.schema(f"id {dict(gold.dtypes)['id']}, entities {SPANS}").json(f"{where}/predictions")
    pairs = evaluate.pair(gold, read)
    artefacts = {
        "facts": evaluate.facts(pairs, name), "error_samples": evaluate.error_samples(pairs),
        "error_ranking": evaluate.error_ranking(pairs), "document_log": evaluate.document_log(pairs),
    }
    for artefact, rows in artefacts.items():
        writers.json_lines(rows, f"{where}/{artefact}")
    return gold.sparkSession.read.schema(artefacts["facts"].schema).json(f"{where}/facts")


def judge(rows: DataFrame, connect: Callable[[], clients.Client]) -> DataFrame:
    """(id, text, anon, ...) -> the same with answer, seconds and the rubric's scores."""
    asked = clients.ask(rows, clients.judge_prompt(F.col("text"), F.col("anon")), connect)
    return asked.withColumn("j", P.judge_scores(F.col("answer"))).select(*asked.columns, *[F.col(f"j.{c}") for s in P.SCORES for c in (s, f"{s}_reason")])


def attack_outcomes(rows: DataFrame) -> DataFrame:
    """(id, truth_answer, guess_answer, verdict_answer, ...) -> the same with truth, guess (placeholders taken out), match
    (attribute -> whether it leaked) and leak_count.

    A verdict of MATCH, NO_MATCH or SKIP decides; an attribute without one is matched by its strings, either in the other.
    """
    told = {n: P.ground_truth(P.repaired(F.col(f"{n}_answer"))) for n in ("truth", "guess")}
    rows = rows.withColumns(told | {"v": P.repaired(F.col("verdict_answer"))})
    clean = F.struct(*[(P.sanitize_list(F.col(f"guess.{a}")) if a in LIST_ATTRIBUTES else P.sanitize(F.col(f"guess.{a}"))).alias(a) for a in ATTRIBUTES])
    rows = rows.withColumn("guess", clean)

    def leaked(a: str) -> Column:
        verdict = F.upper(F.get_json_object("v", f"$.{a}"))
        t, g = F.col(f"truth.{a}"), F.col(f"guess.{a}")
        alike = P.matches_any(t, g) if a in LIST_ATTRIBUTES else P.matches(t, g)
        return F.when(verdict.isin("MATCH", "NO_MATCH", "SKIP"), verdict == "MATCH").otherwise(alike)

    match = F.create_map(*[x for a in ATTRIBUTES for x in (F.lit(a), leaked(a))])
    out = rows.withColumn("match", match).drop("v")
    return out.withColumn("leak_count", F.size(F.filter(F.map_values("match"), lambda m: m)))


def attack(rows: DataFrame, extract: Callable[[], clients.Client], infer: Callable[[], clients.Client], decide: Callable[[], clients.Client]) -> DataFrame:
    """(id, text, anon, ...) -> attack_outcomes of what three models say: of the attributes in the text, of those that the
    anonymized text still tells, and of which guesses are right."""
    for name, prompt, connect in (("truth", clients.truth_prompt(F.col("text")), extract), ("guess", clients.attack_prompt(F.col("anon")), infer)):
        rows = clients.ask(rows, prompt, connect).withColumnRenamed("answer", f"{name}_answer").drop("seconds")
    rows = clients.ask(rows, clients.verdict_prompt(F.col("truth_answer"), F.col("guess_answer")), decide)
    return attack_outcomes(rows.withColumnRenamed("answer", "verdict_answer").drop("seconds"))


def deep_dive(attacks: DataFrame) -> DataFrame:
    """(pipeline, id, ground_truth, attacker_guesses, match) -> one row per attribute: tier, truth, guesses, confidence, verdict."""
    cells = []
    for a, tier in ATTRIBUTES.items():
        truth = F.array_join(F.col(f"ground_truth.{a}"), "; ") if a in LIST_ATTRIBUTES else F.col(f"ground_truth.{a}")
        g = F.try_element_at("attacker_guesses", F.lit(a))
        cells.append(F.struct(F.lit(a).alias("attribute"), F.lit(tier).alias("tier"), truth.alias("truth"), F.array_join(g["guesses"], "; ").alias("guesses"), g["confidence"].alias("confidence"), F.try_element_at("match", F.lit(a)).alias("verdict")))
    return attacks.select("pipeline", "id", F.explode(F.array(*cells)).alias("c")).select("pipeline", "id", "c.*")


def leak_extremes(leaks: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(id, total, leaked, rate, kind, rank): the n documents of highest leakage (ties by id), and n of those without any in an
    order by hash."""
    each = leakage.by_document(leaks)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    first = each.orderBy(F.desc("rate"), "id").limit(n).withColumn("kind", F.lit("highest"))
    return first.unionByName(each.where("leaked = 0").orderBy(order, "id").limit(n).withColumn("kind", F.lit("clean")))
