"""Building a corpus: parsing tagged notes, rules, splits, samples, statistics, and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.functions.text import preview, ratio, words
from larkspan.schema import LABELS, label_tier

SEPARATOR = "###SEPARATOR###"
#: Batch numbers whose notes one task numbers.
STRETCH = 10_000
_TAG = r"<\s*[A-Z]+\s*>"


def parse_batches(batches: DataFrame) -> DataFrame:
    """(batch, meta_temp, content) -> (id, meta_temp, text, entities, raw_content): one row per note of the batches.

    Headers (a line such as **Note 3:** or Notiz 3:) go, notes that are empty or have no tag go, ids count on over all
    batches in the order of their numbers: within stretches of STRETCH batch numbers, and from one stretch to the next by the
    stretches' counts, so that no task holds more than a stretch or a row for each.
    """
    each = batches.select("batch", "meta_temp", F.posexplode(F.split("content", SEPARATOR)).alias("n", "raw"))
    body = S.strip(F.regexp_replace(S.strip(F.col("raw")), r"^(?iu)\**\s*(?:note|notiz|beispiel)\s*\d*\s*:?\**\s*:?\s*\n?", ""))
    each = each.withColumn("raw_content", body).where((F.col("raw_content") != "") & F.col("raw_content").rlike(_TAG))
    text, entities = S.parse_tags(F.col("raw_content"))
    each = each.withColumn("stretch", F.floor(F.col("batch") / STRETCH))
    counts = each.groupBy("stretch").agg(F.count("*").alias("size"))
    before = counts.select("stretch", (F.sum("size").over(Window.orderBy("stretch")) - F.col("size")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("stretch").orderBy("batch", "n"))
    return each.join(before, "stretch").select(F.format_string("doc_%05d", number).alias("id"), "meta_temp", text.alias("text"), entities.alias("entities"), "raw_content")


def rule_reasons(raw: Column, entities: Column) -> Column:
    """Why a tagged note is unfit, joined by "; "; empty if it is fit."""
    count = lambda tag: F.size(F.split(raw, f"\\Q{tag}\\E", -1)) - 1
    uneven = [F.when(count(f"<{x}>") != count(f"</{x}>"), F.lit(f"Unbalanced <{x}> tags")) for x in LABELS]
    valid = F.array(*[F.lit(f"<{s}{x}>") for x in LABELS for s in ("", "/")])
    invalid = F.transform(F.filter(F.regexp_extract_all(raw, F.lit("<[^>]*>"), 0), lambda b: ~F.array_contains(valid, b)), lambda b: F.concat(F.lit("Invalid tag: "), b))
    leaks = F.transform(F.filter(entities, lambda e: e["text"].rlike("[<>]")), lambda e: F.concat(F.lit("Bracket leak in entity: '"), e["text"], F.lit("'")))
    return F.array_join(F.concat(F.filter(F.array(*uneven), lambda x: x.isNotNull()), invalid, leaks), "; ")


def audit(notes: DataFrame) -> DataFrame:
    return notes.withColumn("reasons", rule_reasons(F.col("raw_content"), F.col("entities")))


def proxy_audit(raw: Column) -> Column:
    """What of a semantic audit needs no model: nested tags, an IBAN of another country, a currency as a place."""
    tags = "|".join(LABELS)
    return raw.rlike(rf"<({tags})>[^<]*<({tags})>") | raw.rlike(r"<IBAN>\s*(?!CH)") | raw.rlike(r"<LOC>\s*(?:CHF|EUR|USD|GBP)\b")


def drop_killed(notes: DataFrame, killed: DataFrame) -> DataFrame:
    return notes.join(killed.select("id").distinct(), "id", "left_anti")


def stage_counts(notes: DataFrame, killed: DataFrame) -> DataFrame:
    """(meta_temp, n_input, n_rules, n_audit, n_final): an audit id counts if the rules left its note."""
    k = killed.select("id").distinct().withColumn("killed", F.lit(True))
    rows = audit(notes).join(k, "id", "left").withColumns({"bad": F.col("reasons") != "", "killed": F.coalesce("killed", F.lit(False))})
    out = rows.groupBy(F.coalesce("meta_temp", F.lit("Unknown")).alias("meta_temp")).agg(F.count("*").alias("n_input"), F.count_if("bad").alias("n_rules"), F.count_if(~F.col("bad") & F.col("killed")).alias("n_audit"))
    return out.withColumn("n_final", F.col("n_input") - F.col("n_rules") - F.col("n_audit"))


def rejection_rates(generated: DataFrame, retained: DataFrame) -> DataFrame:
    """(level, generated, retained, rejected, rate) by level and in total."""
    count = lambda d, n: d.groupBy(F.coalesce("meta_temp", F.lit("Unknown")).alias("level")).agg(F.count("*").alias(n))
    rows = count(generated, "generated").join(count(retained, "retained"), "level", "full").na.fill(0)
    total = rows.agg(F.lit("Total").alias("level"), F.sum("generated").alias("generated"), F.sum("retained").alias("retained"))
    out = rows.unionByName(total).withColumn("rejected", F.col("generated") - F.col("retained"))
    return out.withColumn("rate", ratio(F.col("rejected"), F.col("generated")))


def _order(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_split(notes: DataFrame, train: float = 0.5, dev: float = 0.25, seed: int = 42) -> DataFrame:
    """(id, split): within each stratum, in an order by hash, the first floor(n * train), then floor(n * dev), then test."""
    key = F.coalesce("meta_temp", F.lit("Unknown"))
    rows = notes.select("id", key.alias("s")).withColumn("o", _order(seed))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("o", "id"))).withColumn("n", F.count("*").over(Window.partitionBy("s")))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * dev)
    return rows.select("id", F.when(F.col("r") <= a, "train").when(F.col("r") <= a + b, "dev").otherwise("test").alias("split"))


def stratified_sample(notes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n notes in equal shares of the strata, one more for the first n mod k strata by name."""
    rows = notes.withColumn("_s", F.coalesce("meta_temp", F.lit("Unknown")))
    strata = rows.select("_s").distinct()
    k = strata.count()
    if not k:
        return notes
    quota = strata.withColumn("_q", F.lit(n // k) + (F.row_number().over(Window.orderBy("_s")) <= n % k).cast("int"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(_order(seed), "id")))
    return ranked.join(F.broadcast(quota), "_s").where("_r <= _q").drop("_s", "_r", "_q")


def flatten(notes: DataFrame) -> DataFrame:
    """One export row per note: counts, a column n_<label> each, previews and the masked text."""
    per = [F.size(F.filter(F.transform("entities", lambda e: e["label"]), F.lit(x).__eq__)).alias(f"n_{x}") for x in LABELS]
    masked = S.mask_for_export(F.col("text"), F.col("entities"))
    return notes.select("id", "meta_temp", F.length("text").alias("n_chars"), F.size(words(F.col("text"))).alias("n_words"), F.size("entities").alias("n_entities"), *per, preview(F.col("text")).alias("preview"), masked.alias("masked"))


def split_summary(flat: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, n_docs, by stratum, mean characters, entities in total and by document, by label)."""
    rows = flat.join(splits, "id")
    strata = [F.count_if(F.col("meta_temp") == s).alias(f"n_{s.lower()}") for s in ("Low", "Medium", "High")]
    return rows.groupBy("split").agg(F.count("*").alias("n_docs"), *strata, F.avg("n_chars").alias("avg_chars"), F.sum("n_entities").alias("n_entities"), F.avg("n_entities").alias("avg_entities"), *[F.sum(f"n_{x}").alias(f"total_{x}") for x in LABELS])


def dataset_stats(notes: DataFrame, splits: DataFrame) -> dict[str, DataFrame]:
    """Documents by split and complexity, entities by label and split or complexity, tier shares, and spreads."""
    rows = notes.join(splits, "id").withColumn("n_words", F.size(words(F.col("text")))).withColumn("n_entities", F.size("entities"))
    each = rows.select("id", "split", "meta_temp", F.explode("entities").alias("e")).select("id", "split", "meta_temp", "e.label")
    tiers = each.join(F.broadcast(label_tier(notes.sparkSession, False)), "label").groupBy("tier").agg(F.count("*").alias("n"))
    total = tiers.agg(F.sum("n").alias("all"))
    spread = [f(c).alias(f"{name}_{c[2:]}") for c in ("n_entities", "n_words") for name, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return {
        "docs": rows.cube("split", "meta_temp").agg(F.count("*").alias("n")),
        "labels": each.groupBy("label").pivot("split", ["train", "dev", "test"]).count().na.fill(0),
        "complexity": each.groupBy("label", "meta_temp").agg(F.count("*").alias("n")),
        "tiers": tiers.join(F.broadcast(total)).select("tier", "n", ratio(F.col("n"), F.col("all")).alias("share")),
        "spread": rows.agg(*spread),
    }


def verify_expected(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, expected, actual, ok): values by name against what they should be."""
    return expected.join(actual.withColumnRenamed("value", "actual"), "name", "left").select("name", F.col("value").alias("expected"), "actual", F.col("value").eqNullSafe(F.col("actual")).alias("ok"))


def split_records(notes: DataFrame, splits: DataFrame) -> DataFrame:
    """Records of each split in the split's order; ids without a record are passed over. splits: (split, ids)."""
    ids = splits.select("split", F.posexplode("ids").alias("pos", "id"))
    return ids.join(notes, "id").orderBy("split", "pos")


def training_examples(notes: DataFrame, system: str) -> DataFrame:
    """(id, messages): system prompt, the text, and the text with marked entities as the answer."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return notes.select("id", F.array(turn("system", F.lit(system)), turn("user", F.col("text")), turn("assistant", S.mark(F.col("text"), F.col("entities")))).alias("messages"))


def pad(ids: Column, length: int, value: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), length)), 1, length)


def short_enough(rows: DataFrame, ids: str = "input_ids", limit: int = 1024) -> DataFrame:
    return rows.where(F.size(ids) < limit)


def import_tasks(notes: DataFrame) -> DataFrame:
    """Notes as tasks of an annotation tool: data and one annotation with a result per entity."""
    result = F.transform("entities", lambda e: F.struct(F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), F.array(e["label"]).alias("labels")).alias("value")))
    data = F.struct("text", "meta_temp", F.col("raw_content").alias("raw_text"))
    return notes.select(data.alias("data"), F.array(F.struct(result.alias("result"), F.lit(False).alias("was_cancelled"), F.lit(True).alias("ground_truth"))).alias("annotations"))
