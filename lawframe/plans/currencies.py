"""The currency decision over orders as laws and lines as evidence, with its SQL twin, which folds whole lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import currency


def facts(orders: DataFrame) -> DataFrame:
    """Laws of three kinds; every fourth has no number and every ninth no date."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("pl"), F.lit("pvtl"), F.lit("act")), (k % 3 + 1).cast("int"))
    number = F.when(k % 4 != 0, (F.dayofyear("o_orderdate") * 100000 + k % 100000).cast("int"))
    return orders.select(F.concat(F.lit("/us/"), kind, F.lit("/"), k.cast("string")).alias("identifier"), kind.alias("kind"), F.year("o_orderdate").alias("congress"), number.alias("number"), F.when(k % 9 != 0, F.col("o_orderdate").cast("date")).alias("date"), k.alias("key"))


def currency_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    laws = facts(orders)
    named = laws.select(F.col("key").alias("of"), F.col("identifier").alias("law"))
    other = laws.select(F.col("key").alias("to"), F.struct("identifier", "kind", "congress", "number", "date").alias("c"))
    lines = lines.where("l_linenumber <= 5").withColumn("to", F.col("l_partkey") * 7 + F.col("l_suppkey"))
    source = F.when(F.col("l_returnflag") == "A", "source_credit").when(F.col("l_returnflag") == "N", "classification").otherwise("compilation")
    place = (F.col("l_linenumber") * 10000000 + F.col("to")).cast("long")
    evidence = lines.join(named, F.col("l_orderkey") == F.col("of")).join(other, "to").select("law", source.alias("source"), place.alias("place"), "c")
    # every law is also known by the name of the order with the next key
    aliases = named.select("law", (F.col("of") + 1).alias("to")).join(other, "to").select("law", F.col("c.identifier").alias("identifier"))
    covered = lines.where("l_returnflag = 'N'").join(named, F.col("l_orderkey") == F.col("of")).select("law")
    return currency.decided(laws.drop("key"), aliases, evidence, covered)


QUERIES: dict[str, Callable] = {"currency_decision": currency_decision}
ORACLE = {
    "currency_decision": """
WITH f AS (SELECT o_orderkey AS k, '/us/' || ['pl', 'pvtl', 'act'][o_orderkey % 3 + 1] || '/' || o_orderkey AS id, ['pl', 'pvtl', 'act'][o_orderkey % 3 + 1] AS kind, year(o_orderdate) AS c,
 CASE WHEN o_orderkey % 4 <> 0 THEN dayofyear(o_orderdate) * 100000 + o_orderkey % 100000 END AS n, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_partkey * 7 + l_suppkey AS t, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS rank FROM lineitem WHERE l_linenumber <= 5),
e AS (SELECT a.k AS law, rank, l_linenumber * 10000000 + t AS place, {'k': b.k, 'id': b.id, 'kind': b.kind, 'c': b.c, 'n': b.n, 'd': b.d} AS x FROM l JOIN f a ON l_orderkey = a.k JOIN f b ON t = b.k
 WHERE b.k <> a.k AND b.k <> a.k + 1 AND CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL AND (a.kind = b.kind OR a.c <> b.c) THEN (b.c, b.n) > (a.c, a.n) ELSE coalesce(b.d > a.d, false) END),
g AS (SELECT law, list(x ORDER BY rank, place) AS xs, bool_or(rank = 1) AS r1, bool_or(rank = 2) AS r2, bool_or(rank = 3) AS r3, count(DISTINCT x.k) AS candidates FROM e GROUP BY law),
w AS (SELECT *, list_reduce(xs, lambda a, b: CASE WHEN b.k <> a.k AND CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL AND (a.kind = b.kind OR a.c <> b.c) THEN (b.c, b.n) > (a.c, a.n) ELSE coalesce(b.d > a.d, false) END THEN b ELSE a END) AS m FROM g)
SELECT f.id AS law, CASE WHEN m IS NOT NULL THEN 'known_amended' WHEN f.kind <> 'pvtl' AND f.k IN (SELECT l_orderkey FROM l WHERE rank = 2) THEN 'no_record' ELSE 'unknown' END AS status, m.id AS latest,
 CASE WHEN m IS NULL THEN NULL WHEN m.n IS NOT NULL AND m.kind = 'pl' THEN 'Public Law ' || m.c || '-' || m.n WHEN m.n IS NOT NULL AND m.kind = 'pvtl' THEN 'Private Law ' || m.c || '-' || m.n
 ELSE coalesce('Act of ' || strftime(m.d, '%B %-d, %Y'), m.id) END AS latest_label,
 concat_ws(',', CASE WHEN r1 THEN 'source_credit' END, CASE WHEN r2 THEN 'classification' END, CASE WHEN r3 THEN 'compilation' END) AS evidence, coalesce(candidates, 0) AS candidates
FROM f LEFT JOIN w ON w.law = f.k"""
}
