"""Detection, masking and running counts over streamed notes.

Detectors are column expressions, so the same plan serves batches and streams; only counts need state, bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspan.functions import spans as S
from larkspan.operators.detect import pattern_spans


def read_notes(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Notes (id, text, ts) as JSON lines that arrive in a folder."""
    return spark.readStream.schema("id bigint, text string, ts timestamp").option("maxFilesPerTrigger", files_per_trigger).json(path)


def masked(notes: DataFrame, catalogue: str = "base") -> DataFrame:
    """Adds entities and the text with placeholders."""
    found = notes.withColumn("entities", pattern_spans(F.col("text"), catalogue))
    return found.withColumn("masked", S.replace(F.col("text"), F.col("entities"), S.placeholder))


def label_counts(notes: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, label, n) of detected spans; what is later than the watermark is left out."""
    each = notes.withWatermark("ts", late).select("ts", F.explode(pattern_spans(F.col("text"))).alias("e"))
    return each.groupBy(F.window("ts", width).alias("window"), F.col("e.label").alias("label")).agg(F.count("*").alias("n"))


def write_masked(notes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Masked notes without their texts, once each, as Parquet."""
    out = masked(notes).select("id", "ts", "masked", F.size("entities").alias("n_entities"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
