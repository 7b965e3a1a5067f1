"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "lawframe", **more: str) -> SparkSession:
    """A session with SETTINGS; on a cluster, leave master to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lawframe-"))
        at = spark.sparkContext.getCheckpointDir()
    return (at if "://" in at or at.startswith("file:") else f"file://{at}").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a new folder of the shared one: read as often as needed, computed once, and there if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/lawframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, most: int = 20_000) -> DataFrame:
    """A written table with a broadcast hint if it holds at most `most` rows, else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def shares(rows: DataFrame, each: int = 200_000) -> int:
    """Partitions for a shuffle of rows, about `each` to a task, however few the session's shuffle partitions are. Parquet counts from its footers."""
    return max(1, -(-rows.count() // each))
