"""What the operators of this subpackage share: shared folders, written tables, checked broadcasts, word expressions."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts, and what is not it.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table may be broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs on one machine, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir() or None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lawframe-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and a lost executor costs nothing of it.

    The driver first collects garbage, so that shuffle files of earlier written tables, which nothing reads again, leave the disks.
    """
    spark = df.sparkSession
    swept(spark)
    path = f"{shared_dir(spark)}/lawframe/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Shuffle files that nothing reads again leave the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(table: DataFrame) -> None:
    """Deletes the folder of a table made by `written`. Only for tables that no later job, nor a result still to be read, depends on."""
    spark = table.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, name: str, by: str, sort: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, bucketed (and sorted) by a column, so that joins on it need no shuffle of this table.

    The catalog holds it only until its files and buckets are known to the DataFrame; the files stay, as the table is external.
    """
    spark = df.sparkSession
    name = f"lawframe_{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
    (writer.sortBy(*sort) if sort else writer).option("path", f"{shared_dir(spark)}/lawframe/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def unbucketed(table: DataFrame) -> DataFrame:
    """A table made by `bucketed`, read without its buckets. Spark 4.1 takes a union of bucketed tables for one that is dealt by
    their buckets, yet may read them unbucketed, and then aggregates it without a shuffle: unions must be of such tables."""
    spark, files = table.sparkSession, table.inputFiles()
    return spark.read.schema(table.schema).parquet(*files) if files else spark.createDataFrame([], table.schema)


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of docs and the whole row as one column `row`, so that no other column can clash; back by `row.*`."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *needed)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it holds at most `most` rows, else as it is. df should be a written table, as it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
