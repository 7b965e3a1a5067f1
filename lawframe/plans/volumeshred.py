"""Volumes as a query: laws made of orders and their lines are written as XML files in the shared folder and read back as units."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import volumes


#: Laws in a file, which is compressed and so is read by one task.
EACH = 10_000


def saved_volumes(orders: DataFrame, lines: DataFrame, path: str) -> None:
    """Writes a law per order, a section per line: every third line shows a page, every fifth part is quoted inside its section.

    Sections are made once a law's lines are together. They are in the order of number and part; lines that are alike in both give the same section."""
    s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")

    def section(line: Column) -> Column:
        number, part = s(line["l_linenumber"]), line["l_partkey"]
        shown = F.when(part % 3 == 0, F.concat(F.lit('<page identifier="/us/stat/9/'), s(part), F.lit('">[9 STAT.]</page>'))).otherwise("")
        quoted = F.when(part % 5 == 0, F.lit('<quotedContent><section><num value="99"/><content>quoted</content></section></quotedContent>')).otherwise("")
        return F.concat(F.lit('<section><num value="'), number, F.lit('">Sec.</num><heading>Part '), s(part), F.lit("</heading><content>Words.<sidenote>aside</sidenote>"), quoted, shown, F.lit("</content></section>"))

    body = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("of"))
    laws = orders.join(body, F.col("l_orderkey") == F.col("o_orderkey"))
    xml = F.concat(
        F.lit("<component><pLaw><meta><dc:type>Public Law</dc:type><docNumber>"), s("o_orderkey"), F.lit("</docNumber><congress>"), (F.year("o_orderdate") - 1900).cast("string"), F.lit("</congress></meta><preface>"),
        F.lit('<page identifier="/us/stat/9/P'), s("o_orderkey"), F.lit('"/></preface><main><title><num value="I">TITLE I</num>'), F.array_join(F.transform("of", section), ""), F.lit("</title></main></pLaw></component>"))
    laws.select(xml.alias("value")).write.option("maxRecordsPerFile", EACH).text(path, compression="gzip")


def volume_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    path = f"{shared_folder(spark)}/lawframe/volumes-{uuid.uuid4().hex}"
    saved_volumes(orders, lines, path)
    units = volumes.units(volumes.laws(spark, path)).where("level = 'section'")
    return units.select("identifier", F.col("occurrence").cast("int").alias("occurrence"), "parent_identifier", "heading", "first_page", F.array_join("pages", ",").alias("pages"), "text", (F.col("seq") - 1).alias("seq"))


QUERIES: dict[str, Callable] = {"volume_shred": volume_shred}
ORACLE = {
    "volume_shred": """
WITH l AS (SELECT o_orderkey, '/us/pl/' || (year(o_orderdate) - 1900) || '/' || o_orderkey AS law, l_linenumber, l_partkey,
 CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT law || '/tI/s' || l_linenumber AS identifier, CAST(row_number() OVER (PARTITION BY o_orderkey, l_linenumber ORDER BY seq) AS INTEGER) AS occurrence, law || '/tI' AS parent_identifier, 'Part ' || l_partkey AS heading,
 coalesce(last_value(CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY o_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'p' || o_orderkey) AS first_page,
 CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS pages, 'Sec. Part ' || l_partkey || ' Words.' || CASE WHEN l_partkey % 5 = 0 THEN ' quoted' ELSE '' END AS text, seq FROM l"""
}
