"""Word-level substring dedup: all copies of a repeated window of words go (operator 2)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspan.llm._repeats import HOT, Spec, remove_repeats, without
from larkspan.llm._shared import table


class _Kept:
    """What stays of a text's words, joined by a space, as counts and a SHA-256, or as text."""

    def __init__(self, text: bool) -> None:
        self.text = text
        self.columns = ["n_words", "n_removed", "text" if text else "kept_sha256"]
        self.types = [pa.int64(), pa.int64(), pa.string()]

    def __call__(self, text: bytes, n: int, gone: np.ndarray | None) -> tuple:
        kept = without(text, gone, True)
        return n, 0 if gone is None else int(gone.sum()), kept.decode("utf-8") if self.text else hashlib.sha256(kept).hexdigest()


def dedup_words(docs: DataFrame, window: int = 35, text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256 or the kept text), one row per input row.

    Words are runs of anything but \\x20 and \\x09-\\x0D. Each word under a window of `window` words of one document
    whose words also start anywhere else goes, judged on the input. Null text: no words. Null and repeated doc_ids
    count as documents of their own. Empty tables give no rows; other columns are ignored.
    """
    last = "text string" if text else "kept_sha256 string"
    gram = max(1, min(8, window // 3))
    return remove_repeats(docs, Spec(True, window, gram, False, hot), _Kept(text), f"doc_id long, n_words long, n_removed long, {last}")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"))
