"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._shared import parts_for, row_slices, table, text_or_empty

_WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: MB of benchmark text that one pass over the documents looks for.
BLOCK_MB = 4
#: Words of passages that are aligned at a time.
CELLS = 1 << 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """A block of test items: ids, words as numbers from 1, and their seeds: pairs of neighbouring words, or single
    words where pairs are not sure to be in every alignment that counts."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    threshold: float
    seeds: np.ndarray  # sorted keys
    owner: list[np.ndarray]  # of each item, the number of the seed at each of its places
    sure: list[int]  # of each item, how many of these places an alignment that reaches the threshold holds at least

    @staticmethod
    def of(rows: list[tuple[int, str]], threshold: float) -> Items:
        vocabulary: dict[str, int] = {}
        ids, texts = [], []
        for item, text in rows:
            found = words(text)
            if found:
                ids.append(item)
                texts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int64))
        keys, sure = [], []
        for t in texts:
            # k matches with d edits score 2k - d. For a threshold of a half, 2k - d >= k + (item words passed over), so of
            # the k - 1 steps between matches a third of the item less one go to the item's next word over one word of
            # the text at most (five words or more; in shorter items and for lower thresholds only matches are sure)
            paired = threshold >= 0.5 and len(t) >= 5
            keys.append(_keys(t[:-1], t[1:]) if paired else _keys(t))
            sure.append(max(1, -(-len(t) // 3) - 1) if paired else least_matches(len(t), threshold))
        seeds = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return Items(ids, texts, vocabulary, threshold, seeds, [np.searchsorted(seeds, k) for k in keys], sure)

    def numbers(self, text: str) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of seeds among a text's words, and the seeds' numbers; between a pair's words one other may stand."""
        at, which = [], []
        known = x > 0
        for step in (0, 1, 2):
            full = np.flatnonzero(known[: len(x) - step] & known[step:]) if len(x) > step else np.zeros(0, np.int64)
            keys = _keys(x[full], x[full + step]) if step else _keys(x[full])
            k = np.minimum(np.searchsorted(self.seeds, keys), len(self.seeds) - 1)
            same = self.seeds[k] == keys
            at.append(full[same]), which.append(k[same])
        return np.concatenate(at), np.concatenate(which)


def least_matches(size: int, threshold: float) -> int:
    """Matches that an alignment of score `threshold` or more has at least."""
    return max(1, int(np.ceil(size * threshold - 1e-9)))


def _keys(*columns: np.ndarray) -> np.ndarray:
    """Keys of rows of words: mixed so that up to three words of two million are exact, and longer ones are hashes."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for x in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _pad(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item with its passage: its score, and where it ends in the passage."""
    a, b = _pad(items, -1), _pad(passages, -2)
    ramp = -GAP * np.arange(b.shape[1] + 1, dtype=np.int32)
    above = np.zeros((len(a), b.shape[1] + 1), np.int32)
    best, end = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        same = np.where(a[:, i, None] == b, MATCH, MISMATCH).astype(np.int32)
        here = np.zeros_like(above)
        np.maximum(above[:, :-1] + same, above[:, 1:] + GAP, out=here[:, 1:])
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        here[a[:, i] < 0] = 0
        top = here.argmax(axis=1)
        value = np.take_along_axis(here, top[:, None], 1)[:, 0]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = here
    return best, end


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.seeds), np.int64)
        for _, texts in row_slices(batches, "text"):
            for t in texts:
                total += np.bincount(items.hits(items.numbers(t.decode()))[1], minlength=len(total)) if t else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    return run


def _rare(items: Items, frequency: np.ndarray) -> dict[int, list[int]]:
    """Seed -> items: of each item its rarest seeds that occur, without as many of the commonest places as leave none of
    the alignments that count without a seed. Ranked within the item, so an item that has leaked everywhere keeps its seeds."""
    out: dict[int, list[int]] = {}
    for i, (own, sure) in enumerate(zip(items.owner, items.sure)):
        ranked = own[np.argsort(frequency[own], kind="stable")[: len(own) - sure + 1]]
        for k in np.unique(ranked[frequency[ranked] > 0]).tolist():
            out.setdefault(k, []).append(i)
    return out


class _Finder:
    """Looks for a block's items in texts."""

    def __init__(self, items: Items, seeds: dict[int, list[int]]) -> None:
        self.items, self.seeds, self.threshold = items, seeds, items.threshold
        self.lists = [t.tolist() for t in items.words]
        self.least = [least_matches(len(t), items.threshold) for t in items.words]
        self.chosen = np.zeros(len(items.seeds) + 1, bool)
        self.chosen[list(seeds)] = True

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int, float, int]]:
        """(number of the text, number of the item, score, end) of the best alignments that reach the threshold."""
        items, jobs = self.items, []
        for r, t in enumerate(texts):
            if not t:
                continue
            x = items.numbers(t.decode())
            at, which = items.hits(x)
            keep = self.chosen[which]
            places: dict[int, list[int]] = {}
            for p, k in zip(at[keep].tolist(), which[keep].tolist()):
                for i in self.seeds[k]:
                    places.setdefault(i, []).append(p)
            for i, found in places.items():
                m, reach = len(items.words[i]), -1
                span = 3 * m - int(2 * m * self.threshold)  # words of the text that an alignment may take up
                for p in sorted(found):  # hits near each other share a window, of about five item lengths
                    if p + span > reach:
                        lo, reach = max(0, p - span), p + span + m
                        there = set(x[lo:reach].tolist())
                        if sum(map(there.__contains__, self.lists[i])) >= self.least[i]:
                            jobs.append((r, i, lo, x[lo:reach]))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        jobs.sort(key=lambda j: len(items.words[j[1]]))
        a = 0
        while a < len(jobs):
            # passages are filled up to one length: few long ones or many short ones
            n, widest = 1, len(jobs[a][3])
            while n < 256 and a + n < len(jobs) and (n + 1) * (widest := max(widest, len(jobs[a + n][3]))) <= CELLS:
                n += 1
            some = jobs[a : a + n]
            a += n
            score, end = smith_waterman([items.words[i] for _, i, _, _ in some], [w for *_, w in some])
            for (r, i, lo, _), s, e in zip(some, score.tolist(), end.tolist()):
                share = s / (MATCH * len(items.words[i]))
                if share >= self.threshold:
                    best[r, i] = max(best.get((r, i), (0.0, 0)), (share, -lo - e))
        return [(r, i, s, -e) for (r, i), (s, e) in sorted(best.items())]


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[_Finder]:
    """A finder for each block of test items; seeds are ranked by their count in all documents."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    texts = docs.select(text_or_empty().alias("text"))
    blocks = parts_for(tests, "text", BLOCK_MB)
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items.of([tuple(r) for r in rows], threshold)
        if not len(items.seeds):
            continue
        frequency = np.zeros(len(items.seeds), np.int64)
        for seed, count in texts.mapInArrow(_count(items), "seed long, n long").groupBy("seed").sum("n").collect():
            frequency[seed] = count
        yield _Finder(items, _rare(items, frequency))


def _align(find: _Finder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_slices(batches, "text", 2 << 20):
            ids, found = rows.column(0).to_pylist(), find(texts)
            cols = [[ids[r] for r, *_ in found], [find.items.ids[i] for _, i, *_ in found], [s for *_, s, _ in found], [e for *_, e in found]]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "score", "end_word"])

    return run


def _without(find: _Finder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_slices(batches, "text", 2 << 20):
            gone = {r for r, *_ in find(texts)}
            yield rows.filter(pa.array([r not in gone for r in range(len(texts))], pa.bool_()))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text, ...), (item_id, text, ...) -> (doc_id, item_id, score, end_word): documents that hold a copy of a test item.

    Words are lower-cased runs of letters, digits and _. Seeds are pairs of an item's neighbouring words, in the text next
    to each other or with one word between (single words for items of under five words, and for thresholds under a half),
    without the commonest by their count in all documents: so few that every alignment that reaches the threshold holds
    one that is left. Around each seed the item is aligned
    (+2, -1, -1); score is the best alignment's share of a full match and is at least the threshold; end_word is
    where that ends, of equally good ones the first. Long texts are searched whole, around each seed. The test items are taken in blocks of bounded size, each against all rows; one row for each
    document row and item. Null or empty texts on either side match nothing; null ids are passed on; repeated rows are
    rows of their own; empty tables give no rows; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, item_id long, score double, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for find in _blocks(docs, benchmark, threshold):
        out = out.unionByName(slim.mapInArrow(_align(find), schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that hold no copy of a test item; copies are found as in contaminated()."""
    out = docs
    for find in _blocks(docs, benchmark, threshold):
        out = out.mapInArrow(_without(find), docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
