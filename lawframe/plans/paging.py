"""The paged source as a query: a table is saved page by page in the shared folder and read back through the source."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.paged import PagedSource

PAGE = 500


def saved_pages(entries: DataFrame, root: str, page: int = PAGE) -> None:
    """Writes (congress, session, place, item as JSON) as pages and their totals; each page goes on for a tenth of a page into the next."""
    from pyarrow import fs

    def put(name: str, content: dict) -> None:
        at, base = fs.FileSystem.from_uri(root)
        at.create_dir(base, recursive=True)
        with at.open_output_stream(f"{base}/{name}") as f:
            f.write(json.dumps(content).encode())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A page's entries come one after the other; only one page is held."""
        now, items, done = None, [], 0

        def save() -> None:
            put(f"entries-{now[0]}-{now[1]}-{now[2] * page}.json", {"items": items})

        for b in batches:
            for c, s, p, item in zip(*(b.column(x).to_pylist() for x in ("congress", "session", "page", "item")), strict=True):
                if now != (c, s, p):
                    if items:
                        save()
                        done += 1
                    now, items = (c, s, p), []
                items.append(json.loads(item))
        if items:
            save()
            done += 1
        yield pa.RecordBatch.from_pydict({"pages": pa.array([done], pa.int64())})

    n, more = F.col("place"), page // 10
    on = F.when((n >= page) & (n % page < more), F.array((n / page).cast("int"), (n / page).cast("int") - 1)).otherwise(F.array((n / page).cast("int")))
    head = ["congress", "session", "page"]
    pages = entries.withColumn("page", F.explode(on)).repartition(*head).sortWithinPartitions(*head, "place").select(*head, "item")
    pages.mapInArrow(write, "pages long").write.format("noop").mode("overwrite").save()
    totals = entries.groupBy("congress", "session").agg(F.count("*").alias("total")).collect()
    put("tables.json", {"tables": [r.asDict() for r in totals]})


def paged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of tables by year and a sixteenth of the customers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("congress"), (F.col("o_custkey") % 16).cast("int").alias("session"), "o_orderkey", "o_orderstatus")
    placed = orders.withColumn("place", F.row_number().over(Window.partitionBy("congress", "session").orderBy("o_orderkey")) - 1)
    root = f"{shared_folder(spark)}/lawframe/pages-{uuid.uuid4().hex}"
    saved_pages(placed.select("congress", "session", "place", F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("item")), root)
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").options(root=root, items="o_orderkey long, o_orderstatus string", page=str(PAGE), pages="4").load()
    return rows.select("congress", "session", "place", "total", "o_orderkey", "o_orderstatus", "error")


QUERIES: dict[str, Callable] = {"paged_entries": paged_entries}
ORACLE = {
    "paged_entries": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS congress, CAST(o_custkey % 16 AS INTEGER) AS session, row_number() OVER (PARTITION BY year(o_orderdate), o_custkey % 16 ORDER BY o_orderkey) - 1 AS place,
 count(*) OVER (PARTITION BY year(o_orderdate), o_custkey % 16) AS total, o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS error FROM orders"""
}
