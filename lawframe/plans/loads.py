"""Loads of the shop's tables that write: three batches of client changes upserted with children, aliases and links.

A change is a record of its client, which outranks others by its source; its columns are its children, its place is a name
that one client may have, and sales are links to clients.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import family
from ..session import shared_folder, written

#: When the batches end; changes without a time come with the last.
ENDS = ("2024-02-01", "2024-03-15")


def batches(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, DataFrame, DataFrame | None]]:
    """(batch, records, children, links) of each batch; links come with the first and the last."""
    changes = written(spark.read.parquet(f"{sf_dir}/client_changes.parquet").distinct(), "changes").withColumns({"key": F.col("client_id"), "seq": F.col("change_id")})
    rank = F.when(F.col("source") == "crm", 3).when(F.col("source") == "store", 2).when(F.col("source") == "web", 1).otherwise(0)
    names = F.array(F.concat_ws("/", "city", "segment", F.floor(F.col("balance") / 100)), F.concat(F.lit("c"), F.col("key")))
    records = changes.select("key", rank.alias("rank"), "seq", names.alias("names"), F.struct("op", "segment", "city", "balance").alias("body"), "valid_at")
    child = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("segment", "city", "balance"))))
    children = changes.select("key", "seq", child.alias("child"), "valid_at").where("child.value IS NOT NULL")
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet").select(F.col("client_id").alias("key"), F.col("sale_id").alias("link_id"), "sold_at")
    out, since = [], None
    for i, until in enumerate((*ENDS, None)):
        part = F.lit(True) if since is None else F.col("valid_at") >= since
        part = part & (F.col("valid_at") < until) if until else part | F.col("valid_at").isNull()
        early = F.coalesce(F.col("sold_at") < ENDS[0], F.lit(False))
        links = sales.where(early) if i == 0 else sales.where(~early) if until is None else None
        out.append((f"batch-{i + 1}", records.where(part).drop("valid_at"), children.where(part).drop("valid_at"), links if links is None else links.drop("sold_at")))
        since = until
    return out


def family_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds of each client after the three batches, and what became of it in the last one it was in.

    `stray` counts children, aliases and links that point at another row than the client's; it is 0. Writes into a new folder.
    """
    store = family.Store(spark, f"{shared_folder(spark)}/family-{uuid.uuid4().hex}")
    done = [family.upsert(store, *b).withColumn("n", F.lit(i)) for i, b in enumerate(batches(spark, sf_dir))]
    outcomes = done[0].unionByName(done[1]).unionByName(done[2]).groupBy("key").agg(F.max_by("outcome", "n").alias("outcome"), F.count("*").alias("batches"), F.sum("aliases_dropped").alias("dropped"))
    listed = store.current()[1]
    out = store.table("records", listed).select("key", "rank", "seq", "row_id", "body.city")
    stray = F.lit(0)
    for name in ("children", "aliases", "links"):
        held = store.table(name, listed).groupBy("key", F.col("row_id").alias("to")).agg(F.count("*").alias("n"))
        # per key there is one row_id at most, or stray ones beside it
        tied = held.join(out.select("key", "row_id"), "key").groupBy("key").agg(F.sum("n").alias(f"n_{name}"), F.sum(F.when(F.col("to").eqNullSafe(F.col("row_id")), 0).otherwise(F.col("n"))).alias(f"stray_{name}"))
        out = out.join(tied, "key", "left")
        stray = stray + F.coalesce(f"stray_{name}", F.lit(0))
    counts = [F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name in ("children", "aliases", "links")]
    return out.join(outcomes, "key").select("key", "rank", "seq", "city", "outcome", "batches", "dropped", *counts, stray.alias("stray"))


QUERIES: dict[str, Callable] = {"family_upsert": family_upsert}
ORACLE: dict[str, str] = {}
