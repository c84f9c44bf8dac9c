"""Readers: each has an explicit schema, so no pass over the data infers one, and columns are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.schema import EXPORT, LABELS, PREDICTION


def _json(spark: SparkSession, path: str | list[str], schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def export(spark: SparkSession, path: str, ordered: bool = False, lines: bool = False) -> DataFrame:
    """Annotated export -> (id, text, meta_temp, entities); the first label counts, unknown ones are dropped."""
    raw = _json(spark, path, f"{EXPORT}, data struct<text:string>", lines)
    spans = F.transform(F.coalesce("label", F.array().cast("array<struct<start:int,end:int,text:string,labels:array<string>>>")), lambda a: S.span(a["start"], a["end"], F.get(a["labels"], F.lit(0)), a["text"]))
    kept = F.filter(spans, lambda e: e["label"].isin(*LABELS))
    text = F.coalesce(F.nullif("text", F.lit("")), F.col("data.text"))
    return raw.select("id", text.alias("text"), F.coalesce("meta_temp", F.lit("Unknown")).alias("meta_temp"), (S.by_start(kept) if ordered else kept).alias("entities"))


def splits(spark: SparkSession, path: str) -> DataFrame:
    """Split definition -> (id, split)."""
    raw = _json(spark, path, "train_ids array<bigint>, dev_ids array<bigint>, test_ids array<bigint>, seed int, split string")
    named = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}_ids").alias("ids")) for s in ("train", "dev", "test")])
    return raw.select(F.explode(named).alias("s")).select("s.split", F.explode("s.ids").alias("id"))


def in_split(rows: DataFrame, split_ids: DataFrame, split: str = "test") -> DataFrame:
    return rows.join(split_ids.where(F.col("split") == split), "id", "left_semi")


def predictions(spark: SparkSession, path: str, pipeline: str | None = None, lines: bool = False) -> DataFrame:
    """(pipeline, id, entities); without a name the pipeline is the file's, less its ending."""
    raw = _json(spark, path, PREDICTION, lines)
    return raw.select((F.lit(pipeline) if pipeline else named("_predictions")).alias("pipeline"), "id", "entities")


def named(suffix: str):
    return F.regexp_replace(F.col("_metadata.file_name"), rf"{suffix}\.json$", "")


def rewrites(spark: SparkSession, path: str, pipeline: str, lines: bool = False) -> DataFrame:
    """(pipeline, id, rewritten). Ids are strings, those that are numbers as such ("007" is "7"), others as they are."""
    raw = _json(spark, path, "id string, rewritten_text string", lines)
    key = F.coalesce(F.trim("id").try_cast("bigint").cast("string"), F.col("id"))
    return raw.select(F.lit(pipeline).alias("pipeline"), key.alias("id"), F.col("rewritten_text").alias("rewritten"))


_GUESSES = "map<string,struct<guesses:array<string>,confidence:string,reasoning:string>>"
_TRUTH = "struct<person:array<string>,age:string,location:string,occupation:string,education:string,nationality:string,organization:array<string>>"


def attacks(spark: SparkSession, pattern: str) -> DataFrame:
    """All attack files of a glob: (pipeline from the file's name, id, complexity, ground_truth, attacker_guesses, match)."""
    raw = _json(spark, pattern, f"id bigint, complexity string, ground_truth {_TRUTH}, attacker_guesses {_GUESSES}, match map<string,string>")
    return raw.select(named("_attack_scores").alias("pipeline"), "id", "complexity", "ground_truth", "attacker_guesses", "match")


def truth_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of id -> attributes, as (id, truth)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{_TRUTH}>")).alias("id", "truth")).withColumn("id", F.col("id").cast("bigint"))


def document_metrics(spark: SparkSession, path: str, pipeline: str, lines: bool = False) -> DataFrame:
    """Text metrics by document; a missing file is an empty table."""
    schema = "id bigint, complexity string, levenshtein_masked double, rouge1_full double, bleu4_full double, pii_leaked int, pii_total int"
    try:
        return _json(spark, path, schema, lines).withColumn("pipeline", F.lit(pipeline))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).withColumn("pipeline", F.lit(pipeline))


def evaluation(spark: SparkSession, path: str, pipeline: str) -> DataFrame:
    """A nested evaluation file as facts: (pipeline, subset, matching, tier, precision, recall, f1)."""
    score = "struct<precision:double,recall:double,f1:double>"
    raw = spark.read.text(path, wholetext=True)
    tree = F.from_json("value", f"map<string,map<string,map<string,struct<overall:{score}>>>>")
    rows = raw.select(F.explode(tree).alias("subset", "m")).select("subset", F.explode("m").alias("matching", "t")).select("subset", "matching", F.explode("t").alias("tier", "v"))
    return rows.select(F.lit(pipeline).alias("pipeline"), "subset", "matching", "tier", "v.overall.*")


def training_log(spark: SparkSession, final: str, live: str) -> DataFrame:
    """Epochs of a run, from the final log and, where that lacks them, the live one."""
    schema = "run string, epoch int, f1 double, loss double"
    a, b = (spark.read.schema(schema).json(p) for p in (final, live))
    c = [F.coalesce(F.col(f"a.{x}"), F.col(f"b.{x}")).alias(x) for x in ("f1", "loss")]
    return a.alias("a").join(b.alias("b"), ["run", "epoch"], "full").select("run", "epoch", *c)


