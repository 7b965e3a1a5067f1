"""The newest of a group's rows, in groups of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawframe.operators import sequence
from lawframe.plans import catalogue


def test_beyond_a_million_rows(spark, tmp_path):
    """One user's newest event is the last but one of 1,000,004 in event_id order."""
    n = 1_000_004
    events = spark.range(n).select(F.lit(7).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.when(F.col("id") >= n - 2, n).otherwise(F.col("id") % 1000)).alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalogue.queries()["newest_fold"](spark, str(tmp_path)).select("user_id", "event_id").collect()] == [(7, n - 2)]
    fold = events.groupBy("user_id").agg(sequence.folded(F.col("event_id"), F.struct("ts", "event_id"), lambda x, a: x["ts"] > a["ts"]).alias("b"))
    assert fold.select("b.event_id").collect()[0][0] == n - 2


def test_same_as_the_fold(spark):
    rows = [(1, 1, None), (1, 2, 5), (2, 1, 5), (2, 2, None), (2, 3, 5), (3, 1, 4), (3, 2, 9), (3, 3, 9), (3, 4, 2), (4, 1, None)]
    d = spark.createDataFrame(rows, "k long, id long, at long").groupBy("k")
    fold = d.agg(sequence.folded(F.col("id"), F.struct("at", "id"), lambda x, a: x["at"] > a["at"]).alias("b")).select("k", "b.id")
    got = d.agg(sequence.newest(F.col("at"), F.col("id"), F.col("id")).alias("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold.collect())) == [(1, 1), (2, 1), (3, 2), (4, 1)]
