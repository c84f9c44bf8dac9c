"""How much of a text anonymization keeps: masked pairs, edit distance, ROUGE, BLEU, embeddings, and their aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.functions.rows import keep
from larkspan.functions.text import bleu4, edit_distance, leaked, ratio, rouge1

METRICS = ("levenshtein_masked", "rouge1_full", "bleu4_full")
#: Those and the ones that an embedding model gives.
ALL_METRICS = (*METRICS, *(f"bertscore_{kind}_{x}" for kind in ("masked", "full") for x in ("p", "r", "f1")))


def _scores(original: Column, changed: Column, a: Column, b: Column) -> list[Column]:
    return [edit_distance(a, b).alias(METRICS[0]), rouge1(changed, original).alias(METRICS[1]), bleu4(changed, original).alias(METRICS[2])]


def _leaks(text: Column, gold: Column) -> list[Column]:
    total = F.size(gold)
    n = F.size(F.filter(gold, lambda e: leaked(text, e["text"])))
    return [total.alias("pii_total"), n.alias("pii_leaked"), ratio(n, total).alias("pii_leakage_rate")]


def tagged_metrics(pairs: DataFrame) -> DataFrame:
    """(id, meta_temp, text, gold, predicted) -> metrics of the text with placeholders; masked pairs hide gold on one side,
    placeholders on the other."""
    kept = S.resolve_longest(F.col("predicted"))
    rows = pairs.withColumn("anon", S.replace(F.col("text"), kept, S.placeholder)).withColumn("anon_gold", S.anonymize(F.col("text"), F.col("gold")))
    a, b = S.mask_spans(F.col("text"), F.col("gold")), S.mask_placeholders(F.col("anon"))
    rows = rows.withColumns({"mask_a": a, "mask_b": b})
    lengths = [F.length("text").alias("original_length"), F.length("anon").alias("anonymized_length"), F.length("anon_gold").alias("gold_anonymized_length")]
    return rows.select("id", F.col("meta_temp").alias("complexity"), *lengths, F.size("predicted").alias("num_pred_entities"), F.size("gold").alias("num_gold_entities"), *_leaks(F.col("anon"), F.col("gold")), *_scores(F.col("text"), F.col("anon"), F.col("mask_a"), F.col("mask_b")))


def rewritten_metrics(rows: DataFrame) -> DataFrame:
    """(id, meta_temp, text, gold, rewritten) -> metrics of rewritings; empty ones are left out. What gold survives is
    masked as well, whatever its case and surroundings."""
    rows = keep(rows, F.col("rewritten") != "")
    b = S.mask_strings(S.mask_placeholders(F.col("rewritten")), F.transform("gold", lambda e: e["text"]))
    rows = rows.withColumns({"mask_a": S.mask_spans(F.col("text"), F.col("gold")), "mask_b": b})
    lengths = [F.length("text").alias("original_length"), F.length("rewritten").alias("anonymized_length")]
    return rows.select("id", F.col("meta_temp").alias("complexity"), *lengths, *_leaks(F.col("rewritten"), F.col("gold")), *_scores(F.col("text"), F.col("rewritten"), F.col("mask_a"), F.col("mask_b")))


def summarize(metrics: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """(subset, n, mean and sample deviation of each metric, leaked totals) overall and by complexity."""
    each = metrics.withColumn("subset", F.explode(F.array(F.lit("Overall"), F.coalesce("complexity", F.lit("Unknown")))))
    cols = [c for m in names for c in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return each.groupBy("subset").agg(F.count("*").alias("n"), *cols, F.sum("pii_leaked").alias("pii_leaked"), F.sum("pii_total").alias("pii_total"))


def length_ratio(rows: DataFrame) -> DataFrame:
    """Mean of the rounded ratio of rewritten to original length."""
    r = F.round(F.length("rewritten") / F.greatest(F.length("text"), F.lit(1)), 4)
    return rows.agg(F.avg(r).alias("length_ratio"), F.count("*").alias("n"))


def worst_samples(metrics: DataFrame, score: str, n: int = 6, seed: int = 42) -> DataFrame:
    """Lowest scores, n // 3 of each complexity, filled up to n in an order by hash."""
    per = max(1, n // 3)
    w = Window.partitionBy("complexity").orderBy(score, "id")
    ranked = metrics.withColumn("r", F.row_number().over(w))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    return ranked.orderBy(F.col("r") > per, F.when(F.col("r") <= per, F.lit("")).otherwise(order), "complexity", "r").limit(n).drop("r")


def embedding_match(rows: DataFrame, a: str, b: str, embed: Callable[[], Callable[[list[str]], list[np.ndarray]]]) -> DataFrame:
    """Greedy token matching by cosine: (id, a, b) -> (id, precision, recall, f1). embed() loads once a task and gives a
    matrix of token vectors for each text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embed()
        for part in parts:
            out = []
            for x, y in zip(model([t or "" for t in part[a]]), model([t or "" for t in part[b]])):
                if not len(x) or not len(y):
                    out.append((0.0, 0.0, 0.0))
                    continue
                x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
                s = x @ y.T
                p, r = float(s.max(axis=1).mean()), float(s.max(axis=0).mean())
                out.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pd.DataFrame({"id": part["id"], "precision": [o[0] for o in out], "recall": [o[1] for o in out], "f1": [o[2] for o in out]})

    return rows.select("id", a, b).mapInPandas(run, f"id {dict(rows.dtypes)['id']}, precision double, recall double, f1 double")


def with_embeddings(metrics: DataFrame, texts: DataFrame, embed: Callable[[], Callable[[list[str]], list[np.ndarray]]]) -> DataFrame:
    """Metrics by id and (id, text, changed, mask_a, mask_b) -> the metrics with the six scores of ALL_METRICS that need a model."""
    for kind, a, b in (("masked", "mask_b", "mask_a"), ("full", "changed", "text")):
        scores = embedding_match(texts, a, b, embed)
        named = [F.col(c).alias(f"bertscore_{kind}_{x}") for c, x in (("precision", "p"), ("recall", "r"), ("f1", "f1"))]
        metrics = metrics.join(scores.select("id", *named), "id", "left")
    return metrics
