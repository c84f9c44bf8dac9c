"""Sinks: JSON lines and arrays, CSV, one folder per pipeline or split, resumable runs, and append-only logs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint directory. A local session without one gets a
    temporary folder; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="larkspan-")


def json_lines(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).json(path)


def slim(df: DataFrame, *heavy: str) -> DataFrame:
    return df.drop(*(heavy or ("text", "raw_response", "original_text")))


def misses_csv(misses: DataFrame, path: str) -> None:
    cols = {"id": "doc_id", "category": "category", "label": "gold_label", "surface": "gold_text", "start": "gold_start", "end": "gold_end", "fp_labels": "overlapping_fp_labels", "fp_texts": "overlapping_fp_texts"}
    misses.select(*[F.col(a).alias(b) for a, b in cols.items()]).write.mode("overwrite").option("header", True).csv(path)


def array_json(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON array in one file, for small exports: more than `most` rows are an error, as one task writes it all. Larger
    tables go to json_lines."""
    rows = df.select(F.to_json(F.struct("*")).alias("j"))
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write JSON lines")
    body = rows.coalesce(1).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value"))
    body.write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def missing_pipelines(wanted: DataFrame, path: str) -> DataFrame:
    """Of the pipelines wanted, those that have no folder of results yet."""
    spark = wanted.sparkSession
    try:
        done = spark.read.json(path).select("pipeline").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return wanted
    return wanted.join(done, "pipeline", "left_anti")
