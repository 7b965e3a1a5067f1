"""Repeated deliveries: overlapping polls, duplicates within a watermark, windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_since(seen: DataFrame, at: str, overlap: timedelta = timedelta(days=1), default=None):
    """The time to poll from: the newest seen less an overlap; `default` where nothing has been seen."""
    newest = seen.agg(F.max(at)).first()[0]
    return default if newest is None else newest - overlap


def once(rows: DataFrame, keys: list[str], at: str, delay: str = "2 days") -> DataFrame:
    """Each key's first delivery. On a stream, state is kept for `delay`; on a table, for good, by smallest `at`."""
    if rows.isStreaming:
        return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(at, *(c for c in rest if c != at))).alias("first"))
    return first.select(*keys, "first.*").select(*rows.columns)


def counted(rows: DataFrame, at: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, stop, n): rows per tumbling or sliding window; late rows of a stream are let in for `delay`."""
    late = rows.withWatermark(at, delay) if rows.isStreaming else rows
    return late.groupBy(F.window(at, width, slide) if slide else F.window(at, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def sessions(rows: DataFrame, key: str, at: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """(key, start, stop, n): rows of a key with less than `gap` between neighbours."""
    late = rows.withWatermark(at, delay) if rows.isStreaming else rows
    return late.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
