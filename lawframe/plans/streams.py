"""Queries that run as streams, with restarts, over the shop's tables; each writes into a new folder of the shared one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import keyed

#: When the deliveries end.
ENDS = ("2024-02-15", "2024-04-01")
CAPACITY, PER_SECOND = 5.0, 1 / 1200


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, at, id, arrived_at): clicks as requests of their clients; a time after the arrival is the arrival's. Rows without a client, time or arrival are none."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL AND click_id IS NOT NULL")
    at = F.least("ts", "arrived_at").cast("timestamp")
    return clicks.select(F.col("client_id").alias("key"), at.alias("at"), F.col("click_id").alias("id"), F.col("arrived_at").cast("timestamp").alias("arrived_at"))


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, at, id, wait): clicks against their client's bucket of 5 tokens, which fills at one in 20 minutes.

    The clicks come in three deliveries by arrival; the stream starts anew for each and goes on from its checkpoint. The
    delay is the longest between a click and its arrival, so none is dropped. A row without an id, past all others by more
    than the delay, closes the stream: the watermark passes all clicks, so that the result is whole.
    """
    base = f"{shared_folder(spark)}/limiter-{uuid.uuid4().hex}"
    rows = requests(spark, sf_dir)
    span = rows.agg(F.max(F.unix_seconds("arrived_at") - F.unix_seconds("at")).alias("late"), F.max(F.unix_seconds("at")).alias("newest")).first()
    late = (span["late"] or 0) + 1
    closing = rows.limit(0).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("key"), F.timestamp_seconds(F.lit((span["newest"] or 0) + late + 60)).alias("at"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("arrived_at")))
    first, second = (F.to_timestamp(F.lit(e)) for e in ENDS)
    deliveries = [rows.where(F.col("arrived_at") < first), rows.where((F.col("arrived_at") >= first) & (F.col("arrived_at") < second)), rows.where(F.col("arrived_at") >= second), closing]
    for part in deliveries:
        keyed.drop(spark, part, f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        keyed.drained(keyed.limited(stream, CAPACITY, PER_SECOND, f"{late} seconds"), f"{base}/out", f"{base}/state")
    return spark.read.schema("key long, at timestamp, id long, wait double").parquet(f"{base}/out")


QUERIES: dict[str, Callable] = {"rate_limit_stream": rate_limit_stream}
ORACLE: dict[str, str] = {}
