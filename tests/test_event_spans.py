from __future__ import annotations

from larkspan.plans import queries


def test_overlap_scored_reads_every_event(spark, tmp_path):
    spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r)[:3] for r in queries.overlap_scored(spark, str(tmp_path)).collect())
    assert got == [(10, 7, 9), (20, 14, 17), (30, 21, 25)]
