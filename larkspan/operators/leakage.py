"""Which gold strings survive in anonymized texts: by document, pooled and averaged, by label, stratum and tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.functions.rows import numbered
from larkspan.functions.text import leaked, ratio
from larkspan.schema import label_tier


def anonymized(pairs: DataFrame, resolved: bool = False) -> DataFrame:
    """(id, ..., gold, predicted, text) -> the same with anon: predicted spans as placeholders. Unresolved, overlapping
    spans garble each other; resolved, the longer of two stays."""
    return pairs.withColumn("anon", S.anonymize(F.col("text"), F.col("predicted"), resolved))


def seen_text(rewritten: Column, text: Column, spans: Column) -> Column:
    """What a reader gets: the rewriting, else the text with placeholders, else nothing."""
    return F.coalesce(rewritten, F.when(F.size(spans) > 0, S.anonymize(text, spans, False)).otherwise(text), F.lit(""))


def entity_leaks(rows: DataFrame) -> DataFrame:
    """(id, meta_temp, gold, anon) -> one row per gold entity: id, meta_temp, seq, label, surface, leaked."""
    # texts without a letter give no entities: a filter on them would be pushed down, and make each text twice
    each = rows.select("id", F.coalesce("meta_temp", F.lit("Unknown")).alias("meta_temp"), "anon", numbered(F.when(F.col("anon") != "", F.col("gold"))).alias("seq", "e"))
    return each.select("id", "meta_temp", "seq", F.col("e.label").alias("label"), F.col("e.text").alias("surface"), leaked(F.col("anon"), F.col("e.text")).alias("leaked"))


def pooled(leaks: DataFrame) -> DataFrame:
    """(label, meta_temp, total, leaked, rate) for each label, stratum, both, and all (nulls)."""
    sets = leaks.groupingSets([[], ["label"], ["meta_temp"], ["label", "meta_temp"]], "label", "meta_temp")
    out = sets.agg(F.count("*").alias("total"), F.count_if("leaked").alias("leaked"))
    return out.withColumn("rate", ratio(F.col("leaked"), F.col("total")))


def pooled_by_tier(leaks: DataFrame) -> DataFrame:
    tiers = F.broadcast(label_tier(leaks.sparkSession, with_all=False))
    out = leaks.join(tiers, "label").groupBy("tier").agg(F.count("*").alias("total"), F.count_if("leaked").alias("leaked"))
    return out.withColumn("rate", ratio(F.col("leaked"), F.col("total")))


def by_document(leaks: DataFrame, *by: str) -> DataFrame:
    """(id, by..., total, leaked, rate), documents without such entities left out."""
    out = leaks.groupBy("id", *by).agg(F.count("*").alias("total"), F.count_if("leaked").alias("leaked"))
    return out.withColumn("rate", ratio(F.col("leaked"), F.col("total")))


def macro_nonempty(leaks: DataFrame, by: str) -> DataFrame:
    """(by, rate, n_docs): mean over the documents that have such an entity of their rate."""
    return by_document(leaks, by).groupBy(by).agg(F.avg("rate").alias("rate"), F.count("*").alias("n_docs"))


def macro_all(rows: DataFrame, leaks: DataFrame, digits: int = 4) -> DataFrame:
    """(rate, n_docs, total, leaked): mean of rounded rates, documents without entities counting as 0."""
    each = rows.select("id").join(by_document(leaks), "id", "left").na.fill(0)
    return each.agg(F.avg(F.round("rate", digits)).alias("rate"), F.count("*").alias("n_docs"), F.sum("total").alias("total"), F.sum("leaked").alias("leaked"))


def docs_with_leaks(leaks: DataFrame) -> DataFrame:
    each = by_document(leaks)
    out = each.agg(F.count_if(F.col("leaked") > 0).alias("docs_leaking"), F.count("*").alias("docs"))
    return out.withColumn("share", ratio(F.col("docs_leaking"), F.col("docs")))


def leak_samples(rows: DataFrame, top: int = 20, reach: int = 30) -> DataFrame:
    """The first leaked strings with what stands around them in the anonymized text."""
    each = rows.select("id", "anon", numbered(F.col("gold")).alias("seq", "e")).where(leaked(F.col("anon"), F.col("e.text")))
    at = F.call_function("locate", F.lower("e.text"), F.lower("anon"), F.lit(1)) - 1
    where = F.struct(at.alias("start"), (at + F.length("e.text")).alias("end"))
    return each.orderBy("id", "seq").limit(top).select("id", "seq", F.col("e.label").alias("label"), F.col("e.text").alias("surface"), S.context(F.col("anon"), where, reach).alias("context"))


def per_category(leaks: DataFrame) -> DataFrame:
    """(id, total, leaked, rate, by_label: map of label to total, leaked and rate)."""
    cells = by_document(leaks, "label").withColumn("v", F.struct("total", "leaked", "rate"))
    maps = cells.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "v")))).alias("by_label"))
    return by_document(leaks).join(maps, "id")
