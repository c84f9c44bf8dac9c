"""Span evaluation: strict and relaxed matching, precision and recall by label, tier and subset, and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.functions.text import ratio
from larkspan.schema import ALL, LABELS, SPANS, label_tier


def pair(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold documents with their predictions; a document without any has none."""
    plain = F.transform("entities", lambda e: S.span(e["start"], e["end"], e["label"], e["text"])).cast(SPANS)  # without scores and sources
    p = predicted.select("id", plain.alias("predicted"))
    g = gold.withColumnRenamed("entities", "gold").withColumn("gold", F.coalesce("gold", S.no_spans()))
    return g.join(p, "id", "left").withColumn("predicted", F.coalesce("predicted", S.no_spans()))


def _key(e: Column) -> Column:
    return F.struct(e["start"], e["end"], e["label"])


def keys(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, _key))


def strict_parts(gold: Column, predicted: Column) -> dict[str, Column]:
    """Distinct bounds and labels that both have (tp), that only the prediction (fp), or only gold has (fn)."""
    g, p = keys(gold), keys(predicted)
    return {"tp": F.array_intersect(g, p), "fp": F.array_except(p, g), "fn": F.array_except(g, p)}


def relaxed_parts(gold: Column, predicted: Column, share: float = 0.5) -> dict[str, Column]:
    """One-to-one matches in gold order: the unused prediction of that label with the largest overlap to the shorter
    span, the share at least; the earlier prediction on ties. Repeated spans count each time."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("hit"))
    numbered = F.transform(gold, lambda e, i: F.struct(e.alias("e"), i.alias("i")))

    def step(acc: Column, g: Column) -> Column:
        e = g["e"]
        close = lambda p: S.overlap(e, p) / F.nullif(F.least(S.size_of(e), S.size_of(p)), F.lit(0))
        free = lambda p, j: (p["label"] == e["label"]) & (p["start"] < e["end"]) & (e["start"] < p["end"]) & ~F.array_contains(acc["used"], j)
        ranked = F.transform(predicted, lambda p, j: F.when(free(p, j), S.let(close(p), lambda r: F.when(r >= share, F.struct(r.alias("r"), (-j).alias("j"))))))

        def take(best: Column) -> Column:
            hit = F.struct(F.concat(acc["used"], F.array(-best["j"])).alias("used"), F.concat(acc["hit"], F.array(g["i"])).alias("hit"))
            return F.when(best.isNull(), acc).otherwise(hit)

        return S.let(F.array_max(F.filter(ranked, lambda x: x.isNotNull())), take)

    def parts(done: Column) -> Column:
        tp = F.transform(done["hit"], lambda i: _key(F.get(gold, i)))
        fp = F.transform(F.filter(predicted, lambda _, j: ~F.array_contains(done["used"], j)), _key)
        fn = F.transform(F.filter(gold, lambda _, i: ~F.array_contains(done["hit"], i)), _key)
        return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    # matched once for all three, and not anew for each span that is looked at
    out = S.let(F.aggregate(numbered, start, step), parts)
    return {o: out[o] for o in ("tp", "fp", "fn")}


MATCHERS = {"strict": strict_parts, "relaxed": relaxed_parts}


def _outcomes(matching: str) -> Column:
    """An array of outcome (tp, fp, fn), start, end, label."""
    found = F.struct(*[c.alias(o) for o, c in MATCHERS[matching](F.col("gold"), F.col("predicted")).items()])

    def named(parts: Column, outcome: str) -> Column:
        return F.transform(parts[outcome], lambda k: F.struct(F.lit(outcome).alias("outcome"), k["start"].alias("start"), k["end"].alias("end"), k["label"].alias("label")))

    return S.let(found, lambda parts: F.concat(*[named(parts, o) for o in ("tp", "fp", "fn")]))


def outcomes(pairs: DataFrame, matching: str = "strict", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per span: keep..., outcome (tp, fp, fn), start, end, label."""
    return pairs.select(*keep, F.explode(_outcomes(matching)).alias("o")).select(*keep, "o.*")


def _prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def _tally() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]


def by_label(pairs: DataFrame, matching: str = "strict", labels: list[str] = LABELS) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) for every label, also without spans, and for all together."""
    seen = outcomes(pairs, matching).where(F.col("label").isin(*labels)).groupBy("label").agg(*_tally())
    names = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    full = names.join(seen, "label", "left").na.fill(0)
    total = full.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("OVERALL").alias("label"), "tp", "fp", "fn")
    return _prf(full.unionByName(total))


def by_tier(pairs: DataFrame, matching: str = "strict") -> DataFrame:
    """(tier, tp, fp, fn, ...): tiers overlap, as all labels are one too."""
    tiers = F.broadcast(label_tier(pairs.sparkSession))  # twice the vocabulary: 24 rows
    seen = outcomes(pairs, matching).groupBy("label").agg(*_tally())
    return _prf(tiers.join(seen, "label", "left").groupBy("tier").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def by_subset(pairs: DataFrame, matching: str = "strict", stratum: str = "meta_temp") -> DataFrame:
    """(subset, tp, fp, fn, ...): each stratum and Overall, in one pass."""
    rows = outcomes(pairs, matching, ("id", stratum)).where(F.col("label").isin(*LABELS)).groupBy(stratum).agg(*_tally())
    each = rows.select(F.explode(F.array(F.lit("Overall"), F.coalesce(stratum, F.lit("Unknown")))).alias("subset"), "tp", "fp", "fn")
    return _prf(each.groupBy("subset").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def facts(pairs: DataFrame, pipeline: str, stratum: str = "meta_temp") -> DataFrame:
    """The long fact table: pipeline, subset, matching, tier, label, counts and scores. The pairs are read once for all of it."""
    told = lambda m: F.transform(_outcomes(m), lambda o: F.struct(F.lit(m).alias("matching"), o["outcome"].alias("outcome"), o["label"].alias("label")))
    rows = pairs.select(stratum, F.explode(F.concat(*map(told, MATCHERS))).alias("o")).select(stratum, "o.*").groupBy(stratum, "matching", "label").agg(*_tally())
    each = rows.select(F.explode(F.array(F.lit("Overall"), F.coalesce(stratum, F.lit("Unknown")))).alias("subset"), "matching", "label", "tp", "fp", "fn")
    by = ["subset", "tier", "matching", "label"]
    sets = each.join(F.broadcast(label_tier(pairs.sparkSession)), "label").groupingSets([by, by[:-1]], *by)
    out = sets.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping("label").alias("all_labels"))
    label = F.when(F.col("all_labels") == 1, "OVERALL").otherwise(F.col("label")).alias("label")
    return _prf(out.select("subset", "tier", label, "tp", "fp", "fn", "matching")).withColumn("pipeline", F.lit(pipeline))


def error_ranking(pairs: DataFrame, top: int = 25) -> DataFrame:
    """(label, kind, surface, n, rank): a label's most frequent false positives and negatives, ties by surface."""
    rows = outcomes(pairs, "strict", ("id", "text")).where("outcome <> 'tp'")
    seen = rows.groupBy("label", F.upper("outcome").alias("kind"), F.expr("substring(text, start + 1, end - start)").alias("surface")).agg(F.count("*").alias("n"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("label", "kind").orderBy(F.desc("n"), "surface")))
    return ranked.where(F.col("rank") <= top)


def error_samples(pairs: DataFrame, top: int = 15, reach: int = 40) -> DataFrame:
    """The first errors in document order, with their surroundings and the document as tagged text."""
    rows = outcomes(pairs, "strict", ("id", "text", "gold")).where("outcome <> 'tp'")
    at = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    out = rows.orderBy("id", "start", "end", "label", "outcome").limit(top)
    return out.select("id", "outcome", "label", "start", "end", S.context(F.col("text"), at, reach).alias("context"), S.tag(F.col("text"), S.resolve_earliest(F.col("gold"))).alias("tagged"))


def document_log(pairs: DataFrame) -> DataFrame:
    """(id, n_exact, n_missed, n_spurious and the spans themselves) for each document."""
    parts = strict_parts(F.col("gold"), F.col("predicted"))
    cols = {"exact": parts["tp"], "missed": parts["fn"], "spurious": parts["fp"]}
    return pairs.select("id", *[F.size(c).alias(f"n_{n}") for n, c in cols.items()], *[c.alias(n) for n, c in cols.items()])


def misses(pairs: DataFrame) -> DataFrame:
    """Each missed gold span with its category: boundary if a spurious span of its label overlaps it, else label if one of
    another label does, else omission. (id, label, text, start, end, category, fp_labels, fp_texts)"""
    parts = strict_parts(F.col("gold"), F.col("predicted"))
    rows = pairs.select("id", "gold", "predicted", parts["fp"].alias("fp"), F.explode(parts["fn"]).alias("g"))
    meets = F.array_sort(F.filter("fp", lambda p: (F.col("g.start") < p["end"]) & (p["start"] < F.col("g.end"))))
    rows = rows.withColumn("near", meets)
    kind = F.when(F.exists("near", lambda p: p["label"] == F.col("g.label")), "boundary").when(F.size("near") > 0, "label").otherwise("omission")
    # of spans with equal bounds and label the last one's text counts
    last = lambda spans, k: F.coalesce(F.try_element_at(F.filter(spans, lambda e: _key(e) == k), F.lit(-1))["text"], F.lit(""))
    return rows.select(
        "id", F.col("g.label").alias("label"), last(F.col("gold"), F.col("g")).alias("surface"), F.col("g.start").alias("start"), F.col("g.end").alias("end"), kind.alias("category"),
        F.array_join(F.transform("near", lambda p: p["label"]), "|").alias("fp_labels"), F.array_join(F.transform("near", lambda p: last(F.col("predicted"), p)), "|").alias("fp_texts"),
    )


CATEGORIES = ("boundary", "label", "omission")


def miss_summary(pairs: DataFrame) -> DataFrame:
    """(label, gold, n_boundary, n_label, n_omission, recall)."""
    counts = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES]
    found = misses(pairs).groupBy("label").agg(*counts)
    gold = pairs.select(F.explode(keys(F.col("gold"))).alias("g")).groupBy(F.col("g.label").alias("label")).agg(F.count("*").alias("gold"))
    out = gold.join(found, "label", "left").na.fill(0)
    missed = sum((F.col(f"n_{c}") for c in CATEGORIES[1:]), F.col(f"n_{CATEGORIES[0]}"))
    return out.withColumn("recall", ratio(F.col("gold") - missed, F.col("gold")))


def miss_examples(pairs: DataFrame, top: int = 10) -> DataFrame:
    """The first misses of each category."""
    w = Window.partitionBy("category").orderBy("id", "start", "end", "label")
    return misses(pairs).withColumn("n", F.row_number().over(w)).where(F.col("n") <= top)


def side_by_side(facts_of: DataFrame, pipelines: list[str] | None = None) -> DataFrame:
    """(tier, matching) with a column of F1 for each pipeline, from the fact table's overall rows. Without the pipelines' names
    the fact table is made twice, the first time to find them."""
    return facts_of.where("subset = 'Overall' and label = 'OVERALL'").groupBy("tier", "matching").pivot("pipeline", pipelines).agg(F.first("f1"))


def tiers_wide(facts_of: DataFrame) -> DataFrame:
    """(pipeline) with the strict F1 of each tier and each subset as columns."""
    rows = facts_of.where("label = 'OVERALL' and matching = 'strict'")
    tiers = rows.where("subset = 'Overall'").groupBy("pipeline").pivot("tier").agg(F.first("f1"))
    subsets = rows.where(F.col("tier") == ALL).groupBy("pipeline").pivot("subset").agg(F.first("f1"))
    return tiers.join(subsets, "pipeline")


def token_accuracy(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Share of tokens whose labels agree, ignored tokens (label null) left out."""
    each = rows.select(F.explode(F.arrays_zip(F.col(truth).alias("t"), F.col(guess).alias("g"))).alias("x")).where("x.t is not null")
    return each.agg(F.avg((F.col("x.t") == F.col("x.g")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def weighted_f1(pairs: DataFrame) -> DataFrame:
    """(f1, support): mean of the labels' strict F1, weighted by their gold spans."""
    rows = by_label(pairs).where("label <> 'OVERALL'").withColumn("support", F.col("tp") + F.col("fn"))
    return rows.agg(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"), F.sum("support").alias("support"))


def chart_tables(facts_of: DataFrame) -> dict[str, DataFrame]:
    """What charts show, as tidy tables: pipelines by F1, F1 by tier, and F1 by subset (strict, all labels of each)."""
    rows = facts_of.where("label = 'OVERALL' and matching = 'strict'")
    every = rows.where((F.col("subset") == "Overall") & (F.col("tier") == ALL))
    return {
        "ranking": every.select("pipeline", "f1", F.rank().over(Window.orderBy(F.desc("f1"))).alias("rank")),
        "tiers": rows.where("subset = 'Overall'").select("pipeline", "tier", "f1"),
        "subsets": rows.where(F.col("tier") == ALL).select("pipeline", "subset", "f1"),
    }
