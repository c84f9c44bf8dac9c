"""What the operators of this subpackage share: table access, shared storage, batching and graph components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint directory. Where none is set, a local session
    (as in tests) gets a temporary one; on a cluster that would be a folder of each machine's own, so it is an error."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="larkspan-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame written once to shared storage; its lineage ends there, so a lost executor costs nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts_for(df: DataFrame, text: str, mb: int, least: int = 1) -> int:
    """How many parts of about mb MB of text the frame makes; follows the data at every size."""
    total = df.agg(F.sum(F.octet_length(F.col(text)) + F.lit(64)).alias("b")).first()["b"] or 0
    return max(least, int(total // (mb << 20)) + 1)


def row_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut into slices of about limit bytes of text, with the texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0).cast(pa.int64()))
        block = (np.cumsum(sizes) - sizes) // limit
        edges = np.flatnonzero(np.diff(block)) + 1 if len(block) else []
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a), [x or b"" for x in column.slice(a, b - a).to_pylist()]


#: Links that one task contracts at a time.
LINKS = 250_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links -> each of its nodes with the smallest one that the partition's links reach from it."""
    held = list(batches)
    sides = [[np.asarray(b.column(i)) for b in held] for i in (0, 1)]
    if not sides[0]:
        return
    nodes, place = np.unique(np.concatenate([*sides[0], *sides[1]]), return_inverse=True)
    a, b = place[: len(place) // 2], place[len(place) // 2 :]
    label = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(label[a] != label[b])):
        a, b = a[open_], b[open_]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 40, links: int = LINKS) -> DataFrame:
    """(u, v) links between longs -> (node, root): every linked node with the smallest node it can reach.

    Each pass first contracts the links that lie together, about `links` in a task; once all fit there, that is the
    answer. Until then alternating large-star and small-star steps bring links of a node together; they only group and
    join on a node. Passes are cut to shared storage, and nothing but two checksums reaches the driver. Self-links and
    repeats are allowed; no links: no rows.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def sign(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    last = sign(e)
    for _ in range(rounds):
        parts = last[0] // links + 1
        near = e.coalesce(parts).mapInArrow(_stars, "u long, v long")
        if parts == 1:
            e = cut(near)
            break
        both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = sign(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
