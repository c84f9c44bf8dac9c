"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 9)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._shared import row_slices, table, text_or_empty

_WORD = re.compile(r"\w+")
#: Labelled examples of each class that the index holds at most, taken by hash of their ids.
EXAMPLES = 2000
TERMS, NEIGHBOURS, BLOCK, PRIOR = 2048, 15, 64, 0.5
#: Letters of the word beginnings that are terms beside the words.
STEM = 5


def _terms(words: set[str]) -> set[str]:
    return words | {f"{w[:STEM]}*" for w in words if len(w) > STEM}


@dataclass
class Index:
    """Labelled examples as TF-IDF vectors of length one, in blocks, with each term's largest weight in each block."""

    terms: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # examples x terms
    label: np.ndarray
    ids: list
    weight: np.ndarray  # of each example, so that classes count as they do among all labelled rows
    empty: float  # the share of label 1 among examples without terms
    rate: float
    bounds: np.ndarray = field(init=False)
    columns: np.ndarray = field(init=False)
    number: dict = field(init=False)

    def __post_init__(self) -> None:
        lead = self.vectors.argmax(axis=1) if self.vectors.size else np.zeros(len(self.label), int)
        order = np.lexsort((np.arange(len(lead)), lead))  # neighbours in a block share their main term, so bounds are tight
        self.vectors, self.label, self.weight = self.vectors[order], self.label[order], self.weight[order]
        self.ids = [self.ids[i] for i in order]
        rest = -len(order) % BLOCK
        self.columns = np.vstack([self.vectors, np.zeros((rest, self.vectors.shape[1]), np.float32)]).T.copy()
        self.bounds = self.columns.reshape(len(self.terms), -1, BLOCK).max(axis=2) if self.columns.size else self.columns
        self.number = {t: i for i, t in enumerate(self.terms)}

    def vector(self, text: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Numbers of a text's terms, rising, and their counts."""
        found: Counter[int] = Counter()
        get = self.number.get
        for w, n in Counter(_WORD.findall(text.lower())).items():
            for t in (w, f"{w[:STEM]}*") if len(w) > STEM else (w,):
                if (k := get(t)) is not None:
                    found[k] += n
        keys = tuple(sorted(found))
        return keys, tuple(found[k] for k in keys)

    def unit(self, keys: tuple[int, ...], counts: tuple[int, ...]) -> np.ndarray:
        x = (1 + np.log(np.array(counts, np.float32))) * self.idf[list(keys)]
        return (x / np.linalg.norm(x)).astype(np.float32)

    def nearest(self, keys: tuple[int, ...], counts: tuple[int, ...], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (ties: the earlier in the index), without the ones of cosine zero."""
        q, at = self.unit(keys, counts), list(keys)
        bound = q @ self.bounds[at]
        first = np.argsort(-bound, kind="stable")[: -(-k // BLOCK) + 1]

        def score(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            return place, q @ self.columns[np.ix_(at, place)]

        place, s = score(first)
        least = np.partition(s, -k)[-k] if len(s) > k else 0.0
        others = np.setdiff1d(np.flatnonzero(bound >= least - 1e-6), first)
        others = others[bound[others] > 0]
        if len(others):
            more, t = score(others)
            place, s = np.r_[place, more], np.r_[s, t]
        top = np.lexsort((place, -np.round(s, 6)))[:k]
        top = top[(s[top] > 0) & (place[top] < len(self.label))]
        return place[top], s[top]

    def score(self, keys: tuple[int, ...], counts: tuple[int, ...], k: int) -> tuple[float, list, list]:
        if not keys:
            return self.empty, [], []
        place, s = self.nearest(keys, counts, k)
        vote = s.astype(float) ** 2 * self.weight[place]
        value = (float(vote @ self.label[place]) + PRIOR * self.rate) / (float(vote.sum()) + PRIOR)
        return min(max(value, 0.0), 1.0), [self.ids[i] for i in place[:3]], s[:3].astype(float).tolist()


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Index:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0: at most `examples` of each class, by a hash of the
    id. Terms are those whose presence tells most of the label (chi-square); their IDF is of all documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").where(~_held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_slices(batches, "text"):
            found = [_terms(set(_WORD.findall(t.decode().lower()))) for t in texts]
            y = np.repeat(np.asarray(rows.column(0)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array([t for f in found for t in f], pa.string()), pa.array(y, pa.int32())], ["term", "y"])

    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 + n1:
        return Index([], np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros(0), [], np.zeros(0), 0.0, 0.0)
    counts = sample.select("y", "text").mapInArrow(present, "term string, y int").groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    a, b, total_n = F.col("a"), F.col("b"), float(n0 + n1)
    cross = a * (n0 - b) - b * (n1 - a)
    below = (a + b) * (total_n - a - b) * float(max(n0, 1)) * float(max(n1, 1))
    ranked = counts.where("a + b >= 2").withColumn("chi", F.when(below > 0, cross * cross * total_n / below).otherwise(F.lit(0.0)))
    chosen = [r["term"] for r in ranked.where("chi > 6").orderBy(F.desc("chi"), "term").limit(terms).collect()]
    index = Index(chosen, np.ones(len(chosen), np.float32), np.zeros((0, len(chosen)), np.float32), np.zeros(0), [], np.zeros(0), 0.0, 0.0)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(chosen), np.int64), 0
        for _, texts in row_slices(batches, "text"):
            n += len(texts)
            for t in texts:
                seen[list(index.vector(t.decode())[0])] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *seen[some].tolist()], pa.int64())], ["term", "n"])

    df = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) + 1 for i in range(len(chosen))], np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_slices(batches, "text"):
            found = [index.vector(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([k for k, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))], ["doc_id", "y", "k", "c"])

    rows = sorted(map(tuple, sample.mapInArrow(vectors, "doc_id long, y int, k array<int>, c array<int>").collect()))
    share = {y: total.get(y, 0) / max(size.get(y, 0), 1) for y in (0, 1)}
    base = max(min(share.values()), 1e-9) if n0 and n1 else 1.0
    weight = {y: share[y] / base for y in (0, 1)}
    y = np.array([r[1] for r in rows], float)
    w = np.array([weight[r[1]] for r in rows])
    none = np.array([not r[2] for r in rows], bool)
    rate = float(w @ y / w.sum())
    empty = float((w[none] @ y[none] + rate) / (w[none].sum() + 1))
    has = [r for r in rows if r[2]]
    index.idf = idf
    dense = np.zeros((len(has), len(chosen)), np.float32)
    for i, (_, _, k, c) in enumerate(has):
        dense[i, k] = index.unit(tuple(k), tuple(c))
    return Index(chosen, idf, dense, y[~none], [r[0] for r in has], w[~none], empty, rate)


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, text, ...), (doc_id, toxic, ...) -> (doc_id, held_out, score, predicted, evidence_ids, evidence_cosines), one row per input row.

    score: the share of label 1 among the nearest labelled examples, each counting with its squared cosine and its
    class's weight, drawn to the share of label 1 overall; a text without terms (also a null or empty one) gets the
    share among such examples. evidence: the three nearest. Null doc_id: not held out. No labels: score 0. Repeated
    rows are rows of their own, an id with several labels counts as toxic if one says so; empty documents give no
    rows; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, examples, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = index.value, {}
        for rows, texts in row_slices(batches, "text"):
            out = []
            for t in texts:
                key = model.vector(t.decode())
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = model.score(*key, neighbours)
                out.append(known[key])
            score = [s for s, _, _ in out]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([i for _, i, _ in out], pa.list_(pa.int64())), pa.array([c for _, _, c in out], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines"],
            )

    return slim.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below the threshold; rows are judged as in toxicity()."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = index.value
        for rows, texts in row_slices(batches, "text"):
            keep = [model.score(*model.vector(t.decode()), NEIGHBOURS)[0] < threshold for t in texts]
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
