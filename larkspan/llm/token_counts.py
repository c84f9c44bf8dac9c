"""Token counts with a whole-token shortcut (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._shared import row_slices, table, text_or_empty

#: Words a worker remembers at most; then it starts anew, so its memory is bounded.
CACHE = 400_000
#: Texts outside these characters, or with what may be a special token, go through the library as they are.
_PLAIN = re.compile("[^\x00-\x1b\x20-įı-ɏ]|<\\|")


def _is_plain(text: str) -> bool:
    if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _PLAIN.search(text)
    return True


class WordCounter:
    """Tokens of white-space words for a vocabulary whose pre-tokens never hold white space.

    Offline proof: each vocabulary entry that ends a word and that the library encodes alone as one token is whole.
    A pre-token that is whole counts as one; only others are merged, by the library, once for each distinct one.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, decoders

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation(), self.tok.no_padding()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        level = decoders.ByteLevel()
        ends = {level.decode([k[:-4]]): v for k, v in self.tok.get_vocab().items() if k.endswith("</w>")}
        shapes = [s for s in ends if self.split.fullmatch(s) and s == s.lower() and not _PLAIN.search(s)]
        self.is_end = np.zeros(self.tok.get_vocab_size(), bool)
        self.is_end[[v for k, v in self.tok.get_vocab().items() if k.endswith("</w>")]] = True
        self.whole = {s: 1 for s, n in zip(shapes, self._sizes(shapes)) if n == 1}
        self.parts: dict[str, int] = dict(self.whole)
        self.words: dict[str, int] = {}

    def _sizes(self, parts: list[str]) -> list[int]:
        """Tokens of each pre-token: they are encoded side by side, and each one's last token is one that ends a word."""
        out: list[int] = []
        for a in range(0, len(parts), 2048):
            ids = np.array(self.tok.encode(" ".join(parts[a : a + 2048]), add_special_tokens=False).ids, np.int64)
            out += np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1).tolist()
        if len(out) != len(parts):
            raise ValueError("this vocabulary does not end each pre-token with a token of its own")
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > CACHE:
            self.words = {}
        if len(self.parts) > CACHE:
            self.parts = dict(self.whole)
        split = {w: self.split.findall(w) for w in words}
        new = list({p for parts in split.values() for p in parts if p not in self.parts})
        self.parts.update(zip(new, self._sizes(new)))
        for w, parts in split.items():
            self.words[w] = sum(map(self.parts.__getitem__, parts))

    def count(self, texts: list[str]) -> list[int]:
        plain = [t.lower().split() if _is_plain(t) else None for t in texts]
        new = {w for words in plain if words for w in set(words).difference(self.words)}
        known = self.words
        if new:
            self._learn(new)
            if known is not self.words:  # begun anew: the other words of these texts are gone
                self._learn({w for words in plain if words for w in set(words).difference(self.words)})
        get = self.words.__getitem__
        return [len(self.tok.encode(t, add_special_tokens=False).ids) if words is None else sum(map(get, words)) for t, words in zip(texts, plain)]


_counters: dict[str, WordCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    vocabulary: a file name of the tokenizer package, or a path that every executor can open. Null and empty texts
    have no tokens; null and repeated ids are kept; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        if path not in _counters:
            _counters[path] = WordCounter(path)
        counter = _counters[path]
        for rows, texts in row_slices(batches, "text", 1 << 20):
            n = pa.array(counter.count([t.decode() for t in texts]), pa.int64())
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), size, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
