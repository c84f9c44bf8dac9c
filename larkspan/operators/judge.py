"""Rubric scores and inference attacks: aggregates, rates by attribute and tier, grids, runs and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.parse import SCORES
from larkspan.functions.text import ratio
from larkspan.schema import ATTRIBUTES


def score_summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """(score, n, mean, std, median) over all rows or by a column, nulls left out. The mean is rounded to three digits and
    the deviation is taken around that; one value deviates by 0."""
    each = rows.select(*([by] if by else []), F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("v")) for s in SCORES])).alias("x")).select(*([by] if by else []), "x.*").where("v is not null")
    keys = [by, "score"] if by else ["score"]
    parts = each.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("raw"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.round(F.median("v"), 2).alias("median"))
    m = F.round("raw", 3)
    spread = F.greatest(F.col("s2") - 2 * m * F.col("s1") + F.col("n") * m * m, F.lit(0.0))
    std = F.when(F.col("n") > 1, F.sqrt(spread / F.nullif(F.col("n") - 1, F.lit(0)))).otherwise(F.lit(0.0))
    return parts.select(*keys, "n", m.alias("mean"), F.round(std, 3).alias("std"), "median")


def hallucination_rate(rows: DataFrame) -> DataFrame:
    return rows.where("hallucination is not null").agg(F.round(1 - F.avg("hallucination"), 3).alias("hallucination_rate"), F.count("*").alias("n"))


def attack_cells(attacks: DataFrame) -> DataFrame:
    """(pipeline, id, match: map attribute -> verdict) -> one row per attribute with its tier."""
    tiers = F.create_map(*[F.lit(x) for pair in ATTRIBUTES.items() for x in pair])
    each = attacks.select("pipeline", "id", F.explode("match").alias("attribute", "verdict"))
    return each.withColumn("tier", F.try_element_at(tiers, F.col("attribute"))).where("tier is not null")


def attribute_rates(attacks: DataFrame, digits: int | None = 3) -> DataFrame:
    """(pipeline, attribute, tier, n_match, n_no_match, n_skip, rate): rate of matches among judged ones, null if none."""
    out = attack_cells(attacks).groupBy("pipeline", "attribute", "tier").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("MATCH", "NO_MATCH", "SKIP")])
    rate = F.col("n_match") / F.nullif(F.col("n_match") + F.col("n_no_match"), F.lit(0))
    return out.withColumn("rate", rate if digits is None else F.round(rate, digits))


def attack_summary(attacks: DataFrame, digits: int | None = 3) -> DataFrame:
    """(pipeline, docs, any_leak, avg_leak, tier1, tier3): share of judged documents with a match, and means of the
    attributes' rates, rounded first unless digits is None."""
    cells = attack_cells(attacks)
    docs = cells.groupBy("pipeline", "id").agg(F.count_if(F.col("verdict") == "MATCH").alias("m"), F.count_if(F.col("verdict") != "SKIP").alias("j"))
    docs = docs.groupBy("pipeline").agg(F.count("*").alias("docs"), ratio(F.count_if(F.col("m") > 0), F.count_if(F.col("j") > 0)).alias("any_leak"))
    rates = attribute_rates(attacks, digits).groupBy("pipeline").agg(F.avg("rate").alias("avg_leak"), *[F.avg(F.when(F.col("tier") == t, F.col("rate"))).alias(f"tier{t}") for t in (1, 3)])
    return docs.join(rates, "pipeline", "left").orderBy(F.asc_nulls_last("avg_leak"), "pipeline")


def attack_totals(attacks: DataFrame) -> DataFrame:
    """Matches and judged ones by tier and attribute, over all pipelines and by pipeline (rollup; nulls are totals)."""
    judged = attack_cells(attacks).where("verdict <> 'SKIP'")
    out = judged.rollup("tier", "attribute", "pipeline").agg(F.count_if(F.col("verdict") == "MATCH").alias("n_match"), F.count("*").alias("n_judged"))
    return out.withColumn("rate", ratio(F.col("n_match"), F.col("n_judged")))


def leak_counts(attacks: DataFrame) -> DataFrame:
    return attacks.select("pipeline", "id", F.size(F.filter(F.map_values("match"), lambda v: v == "MATCH")).alias("n_leaked"))


def match_grid(attacks: DataFrame, pipelines: list[str]) -> DataFrame:
    """A row per document, a column per pipeline with its number of matches."""
    return leak_counts(attacks).groupBy("id").pivot("pipeline", pipelines).agg(F.first("n_leaked"))


def document_metrics(attacks: DataFrame, semantic: DataFrame, scores: DataFrame) -> DataFrame:
    """Attack outcomes with a document's text metrics and its pipeline's precision and recall, where there are any."""
    return leak_counts(attacks).join(semantic, ["pipeline", "id"], "left").join(scores, "pipeline", "left")


def unjudged(notes: DataFrame, cache: DataFrame) -> DataFrame:
    return notes.join(cache.select("id"), "id", "left_anti")


def attackable(rows: DataFrame) -> DataFrame:
    """Documents of which at least one attribute is known."""
    known = [F.size(a) > 0 if k == "array" else F.col(a).isNotNull() for a, k in ((a, "array" if dict(rows.dtypes)[a].startswith("array") else "") for a in ATTRIBUTES)]
    cond = known[0]
    for k in known[1:]:
        cond = F.coalesce(cond, F.lit(False)) | F.coalesce(k, F.lit(False))
    return rows.where(cond)


def run_stats(responses: DataFrame) -> DataFrame:
    """(docs, seconds, by parse method, failed share, spans before and after verification) of a model's run."""
    methods = [F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("marked", "json_fallback", "xml_fallback", "failed")]
    out = responses.agg(F.count("*").alias("docs"), F.sum("seconds").alias("seconds"), *methods, F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
    return out.withColumns({"avg_seconds": ratio(F.col("seconds"), F.col("docs")), "docs_per_second": ratio(F.col("docs"), F.col("seconds")), "fail_rate": ratio(F.col("n_failed"), F.col("docs")), "removal_rate": ratio(F.col("n_before") - F.col("n_after"), F.col("n_before"))})


def parse_methods(responses: DataFrame) -> DataFrame:
    return responses.groupBy("method").agg(F.count("*").alias("n"))


def running_cost(usage: DataFrame, price_in: float, price_out: float, cap: float = 100.0) -> DataFrame:
    """Calls with their cost and the cost so far; calls after the cap was passed are left out. Calls of a job are ordered
    within their job, so the sum runs per job."""
    cost = (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6
    w = Window.partitionBy("job").orderBy("call").rowsBetween(Window.unboundedPreceding, 0)
    out = usage.withColumn("cost", cost).withColumn("so_far", F.sum("cost").over(w))
    return out.where(F.col("so_far") - F.col("cost") < cap)


def best_so_far(log: DataFrame, patience: int = 3) -> DataFrame:
    """(run, epoch, f1) -> with best, and whether training would have stopped before: patience epochs without a better one."""
    w = Window.partitionBy("run").orderBy("epoch")
    out = log.withColumn("best", F.max("f1").over(w))
    better = F.col("f1") > F.coalesce(F.max("f1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    out = out.withColumn("last", F.max(F.when(better, F.col("epoch"))).over(w))
    stop = F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    return out.withColumn("kept", F.coalesce(F.col("epoch") <= stop, F.lit(True))).drop("last")
