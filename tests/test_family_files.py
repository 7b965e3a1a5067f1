"""An upsert's buckets: as few files as their rows need, several where one key has many rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lawframe.operators import family


def files(store, name):
    return Counter(r[0].split("bucket=")[1].split("/")[0] for r in store.table(name).select("_metadata.file_path").distinct().collect())


def test_one_file_a_bucket(spark, tmp_path):
    ids = spark.range(0, 4000, 1, 8)
    records = ids.select(F.col("id").cast("string").alias("key"), F.lit(1).alias("rank"), F.lit(1).alias("seq"), F.array(F.concat(F.lit("n"), "id")).alias("names"), F.struct(F.lit("T").alias("title")).alias("body"))
    children = records.select("key", "seq", F.struct(F.lit("c").alias("c")).alias("child"))
    links = ids.select(F.when(F.col("id") % 2 == 0, "7").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("link_id"))
    store = family.Store(spark, f"file://{tmp_path}/s", 8)
    family.upsert(store, "a", records, children, links)
    for name in family.TABLES:
        assert files(store, name) == {str(b): 1 for b in range(8)}, name
    kept = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1"}
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        family.upsert(store, "b", records.limit(0), children.limit(0), links)
    finally:
        for k in kept:
            spark.conf.unset(k)
    hot = spark.range(1).select(family.bucket(F.lit("7"), 8)).first()[0]
    assert store.table("links").count() == 8000 and files(store, "links")[str(hot)] > 1
