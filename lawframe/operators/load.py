"""Idempotent loading: precedence upserts, versions, change detection, replaced partitions, promoted generations, run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: str, rank: str, order: str) -> DataFrame:
    """One row per key: the higher rank wins, then the later `order`, then what comes in. With `outcome`: new, replaced, kept, stored."""
    both = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    w = Window.partitionBy(key)
    best = F.row_number().over(w.orderBy(F.desc(rank), F.desc(order), F.desc("_in")))
    marked = both.withColumns({"_r": best, "_old": F.min("_in").over(w) == 0, "_new": F.max("_in").over(w) == 1}).where("_r = 1")
    outcome = F.when(~F.col("_new"), "stored").when(~F.col("_old"), "new").when(F.col("_in") == 1, "replaced").otherwise("kept")
    return marked.withColumn("outcome", outcome).drop("_r", "_old", "_new", "_in")


def children_of(winners: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """Child rows of winning parents only."""
    return children.join(winners.select(*on), on, "left_semi")


def versions(rows: DataFrame, key: str, content: str, at: str) -> DataFrame:
    """One version per key and content hash, first seen at `at`, numbered in time; the last one is current."""
    hashed = rows.withColumn("content_hash", F.sha2(F.col(content).cast("string"), 256))
    once = hashed.groupBy(key, "content_hash").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    w = Window.partitionBy(key)
    n = F.row_number().over(w.orderBy("first_seen", "content_hash"))
    return once.withColumn("version", n).withColumn("is_current", F.row_number().over(w.orderBy(F.desc("last_seen"), F.desc("content_hash"))) == 1)


def changes(stored: DataFrame, listed: DataFrame, key: str, listing: list[str], content: str) -> DataFrame:
    """(key, outcome): skipped if the listing is equal, null by null; unchanged if the content is; else loaded."""
    s = stored.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in [*listing, content]))
    same = F.lit(True)
    for c in listing:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(F.col("_k").isNull(), "loaded").when(same, "skipped").when(F.col(content).eqNullSafe(F.col(f"_{content}")), "unchanged").otherwise("loaded")
    return listed.join(s, F.col(key) == F.col("_k"), "left").select(key, outcome.alias("outcome"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def log_run(spark: SparkSession, path: str, collection: str, ok: bool, message: str = "") -> None:
    spark.range(1).select(F.lit(collection).alias("collection"), F.lit(ok).alias("ok"), F.lit(message).alias("message"), F.current_timestamp().alias("checked_at")).write.mode("append").parquet(path)


def promote(df: DataFrame, root: str) -> str:
    """Writes a new generation and then a pointer row to it; readers of `promoted` see the old one until then."""
    path = f"{root}/gen={uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/pointer")
    return path


def promoted(spark: SparkSession, root: str) -> DataFrame:
    last = spark.read.parquet(f"{root}/pointer").orderBy(F.desc("at"), F.desc("path")).limit(1).first()
    return spark.read.parquet(last["path"])


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one side only, with `side`: gone or new; equal snapshots give none."""
    return before.exceptAll(after).withColumn("side", F.lit("gone")).unionByName(after.exceptAll(before).withColumn("side", F.lit("new")))


def digest(order: Column, values: Column, sep: str = "\n") -> Column:
    """sha256 of the group's values in the order, joined."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), values.cast("string").alias("v")))), lambda r: r["v"]), sep), 256)


def first_wins(claims: DataFrame, alias: str, order: list) -> DataFrame:
    """claims with `kept`: of the rows that claim an alias the first in `order` has it."""
    w = Window.partitionBy(alias).orderBy(*order)
    return claims.withColumn("kept", F.row_number().over(w) == 1)
