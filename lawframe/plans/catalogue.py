"""All named queries of the package and the SQL that DuckDB runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import actnames, answers, compiled, currencies, loads, operatorsuite, paging, relational, searches, streams, summaries, volumeshred

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """A view for each table that the text names."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def from_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        return spark.sql(sql.replace("VARCHAR(10)", "STRING").replace("VARCHAR(20)", "STRING"))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: from_sql(v) for k, v in relational.SHARED.items()} | operatorsuite.QUERIES | answers.QUERIES | searches.QUERIES | paging.QUERIES | volumeshred.QUERIES | currencies.QUERIES | compiled.QUERIES | loads.QUERIES | actnames.QUERIES | streams.QUERIES | summaries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("LEFT ANTI JOIN", "ANTI JOIN") for k, v in relational.SHARED.items()} | operatorsuite.ORACLE | answers.ORACLE | searches.ORACLE | paging.ORACLE | volumeshred.ORACLE | currencies.ORACLE | compiled.ORACLE | loads.ORACLE | actnames.ORACLE | streams.ORACLE | summaries.ORACLE
