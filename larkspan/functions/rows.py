"""Rows of texts and spans: dealt out to tasks, filtered and exploded without working columns out anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts for each core at least, so that no core waits long for the last one.
WAVES = 3
#: Bytes of a larger table's files to a part, so that no task grows with the table, and the parts at most that a shuffle is cut into.
PART_BYTES, MOST_PARTS = 1 << 18, 10_000


def _bytes(rows: DataFrame) -> int:
    """What the rows take by the plan's estimate, for files their size; 0 if it has none."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key over all cores. A table that lies in few files and row groups is read in as few tasks,
    and what is made of its rows without a shuffle would stay in them. The parts grow in number with the table, also where
    the executors that a session waits for have not all come up yet."""
    parts = min(_bytes(rows) // PART_BYTES, MOST_PARTS)
    return rows.repartition(max(WAVES * rows.sparkSession.sparkContext.defaultParallelism, parts), key)


def each(items: Column) -> Column:
    """A row for each item. Of a bare column Spark would first test that it holds any, and push that test down to where the
    column is made: there all that it rests on is written out and worked out once for each mention."""
    return F.explode(F.transform(items, lambda x: x))


def numbered(items: Column) -> Column:
    """Like each, with the item's place: two columns."""
    return F.posexplode(F.transform(items, lambda x: x))


def keep(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on made columns, which a filter would be pushed down past, to work them out twice."""
    once = F.array_repeat(F.lit(0), F.coalesce(condition, F.lit(False)).cast("int"))
    return rows.select("*", F.explode(once).alias("_kept")).drop("_kept")
