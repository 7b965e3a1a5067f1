"""Dense summaries: every key of a spine, each branch aggregated by itself before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spine(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    return df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(name))


def dense(keys: DataFrame, name: str, branches: list[DataFrame], zeros: list[str]) -> DataFrame:
    """keys left-joined with branches that have one row per key; missing counts are 0."""
    out = keys
    for b in branches:
        out = out.join(b, name, "left")
    return out.fillna(0, subset=zeros)


def count_maps(df: DataFrame, key: Column) -> DataFrame:
    """One row: a map from each value of key to its count, as JSON with sorted keys."""
    counted = df.groupBy(key.cast("string").alias("k")).agg(F.count("*").alias("n"))
    return counted.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("counts"))
