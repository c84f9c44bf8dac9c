"""Byte-level dedup: bytes under a string that also starts earlier go (operator 5)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspan.llm._repeats import HOT, Spec, remove_repeats, without
from larkspan.llm._shared import table


class _Kept:
    """What stays of a text's bytes, as counts and a SHA-256, or as text."""

    def __init__(self, text: bool) -> None:
        self.text = text
        self.columns = ["n_bytes", "n_removed", "n_spans", "text" if text else "kept_sha256"]
        self.types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def __call__(self, text: bytes, n: int, gone: np.ndarray | None) -> tuple:
        kept = without(text, gone, False)
        spans = 0 if gone is None else int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        return n, n - len(kept), spans, kept.decode("utf-8", "replace") if self.text else hashlib.sha256(kept).hexdigest()


def dedup_bytes(docs: DataFrame, length: int = 100, text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256 or the kept text), one row per input row.

    Removes each byte under a `length`-byte string of one document that also starts earlier (smaller doc_id, or same
    document and earlier start), judged on the input. Null text: empty. Null doc_id: before all others. Rows with one
    doc_id: in the order of their texts, so of equal rows the first stays. Empty tables give no rows; other columns are
    ignored. Kept text that a cut leaves as invalid UTF-8 shows replacement characters; the hash is of the true bytes.
    """
    last = "text string" if text else "kept_sha256 string"
    gram = max(1, min(32, length // 3))
    return remove_repeats(docs, Spec(False, length, gram, True, hot), _Kept(text), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))
