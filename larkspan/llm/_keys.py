"""Keys of document rows for the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm._shared import text_or_empty

#: Whether the id is null, the id, a hash of the text: rows that agree in all three are one document.
KEY = ["z", "i", "h"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text, z, i, h), null texts empty."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return slim.select("doc_id", "text", F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("h"))
