"""A summary of eleven branches over the shop's months, refreshed after late rows have come."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import family, refreshed
from ..operators.refreshed import Branch
from ..session import shared_folder

#: Source: its columns, and the time by whose month its folder is partitioned.
SOURCES = {
    "sales": ("client_id, status, total, sold_at, arrived_at", "arrived_at"),
    "sale_lines": ("item_id, vendor_id, quantity, flag, shipped_at", "shipped_at"),
    "clicks": ("client_id, ts, kind, arrived_at", "arrived_at"),
    "client_changes": ("client_id, op, valid_at", "valid_at"),
}
#: What arrives from here on comes after the first build.
LATER = "2024-05-01"


def month(at: str) -> str:
    return f"date_format({at}, 'yyyy-MM')"


BRANCHES = [
    Branch("sales", "sales", month("sold_at"), {"n_sales": ("count", "1"), "sales_total": ("sum", "CAST(total AS DECIMAL(20,2))"), "first_sale": ("min", "sold_at"), "last_sale": ("max", "sold_at")}),
    Branch("statuses", "sales", month("sold_at"), {"n_done": ("count", "CASE WHEN status = 'done' THEN 1 END"), "n_open": ("count", "CASE WHEN status = 'open' THEN 1 END"), "n_no_status": ("count", "CASE WHEN status IS NULL THEN 1 END")}),
    Branch("n_buyers", "sales", month("sold_at"), distinct="client_id"),
    Branch("lines", "sale_lines", month("shipped_at"), {"n_lines": ("count", "1"), "quantity": ("sum", "quantity")}),
    Branch("flags", "sale_lines", month("shipped_at"), {"n_flagged": ("count", "flag")}, where="flag <> 'kept'"),
    Branch("n_items", "sale_lines", month("shipped_at"), distinct="item_id"),
    Branch("n_vendors", "sale_lines", month("shipped_at"), distinct="vendor_id"),
    Branch("clicks", "clicks", month("ts"), {"n_clicks": ("count", "1"), "n_kinds": ("count", "kind"), "first_click": ("min", "ts")}),
    Branch("n_visitors", "clicks", month("ts"), distinct="client_id"),
    Branch("changes", "client_changes", month("valid_at"), {"n_changes": ("count", "1"), "n_deleted": ("count", "CASE WHEN op = 'D' THEN 1 END")}),
    Branch("n_changed", "client_changes", month("valid_at"), distinct="client_id"),
]


def delivered(spark: SparkSession, sf_dir: str, source: str, folder: str, which: Column) -> None:
    columns, at = SOURCES[source]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns.split(", "))
    part = F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("none"))
    rows.where(which).withColumn("month", part).repartition("month", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("append").partitionBy("month").parquet(folder)


def summary_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, ..., n_read): each month from January to May 2024 with eleven branches, built from what came before May and refreshed for the rest.

    `n_read` is the number of partitions that the refresh read, of all sources; the others' states stayed. Writes into a new folder.
    """
    base = f"{shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    folders = {s: f"{base}/{s}" for s in SOURCES}
    store = family.Store(spark, f"{base}/store")
    read: dict[str, list[str]] = {}
    for later in (False, True):
        for s, (_, at) in SOURCES.items():
            is_later = F.coalesce(F.col(at) >= F.lit(LATER), F.lit(False))
            delivered(spark, sf_dir, s, folders[s], is_later if later else ~is_later)
        read = refreshed.refresh(store, folders, BRANCHES)
    parts = {(b.source, p) for b in BRANCHES for p in read[b.name]}
    keys = spark.range(1, 6).select(F.format_string("2024-%02d", "id").alias("key"))
    return refreshed.summary(store, keys, BRANCHES).withColumnRenamed("key", "month").withColumn("n_read", F.lit(len(parts)))


QUERIES: dict[str, Callable] = {"summary_refreshed": summary_refreshed}
ORACLE: dict[str, str] = {}
