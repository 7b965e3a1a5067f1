"""Summaries of many branches, kept as partial states per key and refreshed for changed partitions of their sources only.

A source is a folder of Parquet partitions (`name=value`). A partition's stamp is a digest of its files' names, sizes and
times, taken from the listing. A branch keeps, for every partition, its partial states per key: counts, sums, minima and
maxima, or the distinct pairs of key and value. `refresh` reads the partitions whose stamp moved, writes their partial
states into a new folder and publishes which folder holds each partition's states; readers see the old list until then.
A rerun of a refresh that died does what was left, one without changes reads and writes nothing. The summary merges the
partial states, so that a partition's change costs that partition's rows and the (small) states of all.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .family import Store

MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Branch:
    """A branch: rows of a source that meet `where`, per `key` (SQL expressions). Either `measures`, name: (count, sum, min or max,
    SQL expression), or `distinct`, whose different non-null values are counted as column `name`. Rows with a null key are left out.

    A count is of rows for which its expression is not null. Sums should be of decimals or integers: those of doubles depend on
    how rows are dealt, so a refresh and a full build may differ in the last digits.
    """

    name: str
    source: str
    key: str
    measures: dict[str, tuple[str, str]] = field(default_factory=dict)
    distinct: str | None = None
    where: str = "true"

    def definition(self) -> str:
        return hashlib.sha256(repr((self.source, self.key, sorted(self.measures.items()), self.distinct, self.where)).encode()).hexdigest()

    def columns(self) -> list[str]:
        return [self.name] if self.distinct else list(self.measures)

    def counts(self) -> list[str]:
        """Columns that are 0, not null, where a key has no rows."""
        return [self.name] if self.distinct else [n for n, (op, _) in self.measures.items() if op == "count"]


def stamps(spark: SparkSession, folder: str) -> dict[str, str]:
    """{partition's folder name: digest of its listing}. Partitions are listed on the driver, as planning a scan does; no rows are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for part in fs.listStatus(path):
        name = part.getPath().getName()
        if part.isDirectory() and "=" in name:
            files = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(part.getPath()) if f.getPath().getName()[0] not in "._")
            if files:
                found[name] = hashlib.sha256("\n".join(files).encode()).hexdigest()
    return found


def partial(rows: DataFrame, branch: Branch) -> DataFrame:
    """(part, key, ...): the branch's partial states of each partition that rows come from."""
    # the path comes URL-encoded; + stands for itself there. It is looked at for each row, so it is decoded only where it must be
    name = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    part = F.when(F.contains(name, F.lit("%")), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)
    mine = rows.where(branch.where).withColumns({"_part": part, "_key": F.expr(branch.key)}).where("_key IS NOT NULL")
    if branch.distinct:
        return mine.select(F.col("_part").alias("part"), F.col("_key").alias("key"), F.expr(branch.distinct).alias("value")).where("value IS NOT NULL").distinct()
    ops = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    return mine.groupBy(F.col("_part").alias("part"), F.col("_key").alias("key")).agg(*(ops[op](F.expr(e)).alias(n) for n, (op, e) in branch.measures.items()))


def refresh(store: Store, sources: dict[str, str], branches: list[Branch]) -> dict[str, list[str]]:
    """Brings the branches up to date with their sources' folders; the partitions that each read. Nothing moved: nothing is published.

    Stamps are taken before the rows are read: a partition that changes meanwhile has another stamp at the next refresh.
    A branch whose definition changed is built anew, a partition that is gone loses its states.
    """
    spark = store.spark
    number, listed = store.current()
    old = listed.get("summary", {})
    now = {s: stamps(spark, folder) for s, folder in sources.items()}
    new, read = {}, {}
    for b in branches:
        own = {p: f"{b.definition()} {stamp}" for p, stamp in now[b.source].items()}
        was = old.get(b.name, {"parts": {}, "schema": None})
        parts = {p: v for p, v in was["parts"].items() if own.get(p) == v[0]}
        moved = sorted(set(own) - set(parts))
        schema = was["schema"]
        if moved:
            states = partial(spark.read.parquet(*(f"{sources[b.source]}/{p}" for p in moved)), b)
            folder, schema = f"{store.root}/data/{b.name}-{uuid.uuid4().hex}", states.drop("part").schema.json()
            # a partition's states may hold many pairs: they are dealt by key too
            states.repartition("part", F.pmod(F.xxhash64("key", *states.columns[2:]), F.lit(8))).write.partitionBy("part").parquet(folder)
            there = _inside(spark, folder)
            parts |= {p: [own[p], f"{folder}/{there[p]}" if p in there else None] for p in moved}
        new[b.name], read[b.name] = {"parts": parts, "schema": schema}, moved
    if new != old:
        store.publish(number + 1, {**listed, "summary": new})
    return read


def _inside(spark: SparkSession, folder: str) -> dict[str, str]:
    """{partition's folder name in the source: its folder of states}; Spark escapes the = of the one within the other."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = (s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory())
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return {unescaped(n.split("=", 1)[1]): n for n in names if "=" in n}


def merged(store: Store, branch: Branch, listed: dict | None = None) -> DataFrame:
    """(key, ...) of a branch as last published; no rows where its source had none."""
    held = (listed or store.current()[1])["summary"][branch.name]
    folders = sorted({folder for _, folder in held["parts"].values() if folder})
    if not folders:
        schema = StructType.fromJson(json.loads(held["schema"])) if held["schema"] else None
        kept = store.spark.createDataFrame([], schema) if schema else store.spark.range(0).select(F.lit("").alias("key"), *(F.lit(0).alias(c) for c in (["value"] if branch.distinct else branch.columns())))
    else:
        kept = store.spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(*folders)
    if branch.distinct:
        return kept.groupBy("key").agg(F.countDistinct("value").alias(branch.name))
    return kept.groupBy("key").agg(*(MERGE[op](n).alias(n) for n, (op, _) in branch.measures.items()))


def summary(store: Store, keys: DataFrame, branches: list[Branch]) -> DataFrame:
    """keys (key) with all branches' columns; counts are 0, others null, where a key has no rows. All are of one published list."""
    listed = store.current()[1]
    out = keys
    for b in branches:
        out = out.join(merged(store, b, listed), "key", "left")
    return out.fillna(0, [c for b in branches for c in b.counts()])
