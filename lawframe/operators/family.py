"""Upsert of records with what belongs to them: children, aliases, and links from elsewhere, published in one step.

A store is a folder. Its tables lie in buckets of a hash of their key, and a pointer says which folder holds each table's
buckets now. An upsert reads and writes only the buckets that its batch touches, into a folder of its own, and then
publishes a new list of folders as one file, created under the next number; readers see the old list until then. A batch
that dies before that leaves files that no list names; running it again does the whole step, and running a batch
that is published already does nothing. There is one writer at a time: a second one's file of that number would
exist already, and it fails.

Tables: records (key, rank, seq, row_id, names, body); children (key, row_id, child); aliases (name, key, row_id);
links (key, link_id, row_id). body and child are structs of the caller's columns, so no name can clash.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {"records": "key", "children": "key", "aliases": "name", "links": "key"}


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int")


class Store:
    """A folder of tables in n buckets each. The folder's list of (table, bucket, folder) has at most four n rows."""

    def __init__(self, spark: SparkSession, root: str, n: int = 64):
        self.spark, self.root, self.n = spark, root.rstrip("/"), n

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/lists")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> tuple[int, dict]:
        """(number, list) of the newest published list: {"batches": [...], "tables": {table: {bucket: folder}}, "schemas": {table: schema}}."""
        fs, path = self._files()
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()] if fs.exists(path) else []
        if not numbers:
            return 0, {"batches": [], "tables": {t: {} for t in TABLES}, "schemas": {}}
        text = self.spark.read.text(f"{self.root}/lists/{max(numbers)}", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def publish(self, number: int, listed: dict) -> None:
        """Creates the list of that number; fails if there is one. The whole text is in place under another name first."""
        fs, path = self._files()
        spare = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{number}.{uuid.uuid4().hex}")
        out = fs.create(spare, False)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        final = self.spark._jvm.org.apache.hadoop.fs.Path(path, str(number))
        if fs.exists(final) or not fs.rename(spare, final):
            raise FileExistsError(f"{self.root}: list {number} was published by another writer")

    def table(self, name: str, listed: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table as published, or of some of its buckets; None where nothing has been stored in them."""
        listed = listed or self.current()[1]
        folders = {f"{folder}/bucket={b}" for b, folder in listed["tables"][name].items() if only is None or int(b) in only}
        if not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(listed["schemas"][name]))).parquet(*sorted(folders))

    def write(self, batch: str, name: str, rows: DataFrame, touched: list[int], listed: dict) -> None:
        """Writes the touched buckets' rows and enters them in the list; a bucket without rows leaves it."""
        folder = f"{self.root}/data/{name}/{batch}-{uuid.uuid4().hex}"
        # a bucket is one file, or several where a hot key makes it large: adaptive execution splits what is above its size
        rows.withColumn("bucket", bucket(F.col(TABLES[name]), self.n)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        fs, _ = self._files()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = {s.getPath().getName().split("=")[1] for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")}
        for b in map(str, touched):
            listed["tables"][name].pop(b, None)
            if b in found:
                listed["tables"][name][b] = folder
        listed["schemas"].setdefault(name, rows.schema.json())


def _buckets(rows: DataFrame, key: str, n: int) -> list[int]:
    """The buckets that rows fall in, at most n numbers."""
    return sorted(r["b"] for r in rows.select(bucket(F.col(key), n).alias("b")).distinct().collect())


def upsert(store: Store, batch: str, records: DataFrame, children: DataFrame, links: DataFrame | None = None) -> DataFrame | None:
    """Applies a batch to the store and returns its outcomes, (key, outcome, row_id, before, aliases_written, aliases_dropped), or None if it is published already.

    records (key, rank, seq, names, body): of a key's rows in the batch that of the highest rank stands, then of the highest
    seq, then the largest by body and names as texts; a null key is dropped. It is `kept` if the stored rank is higher, which
    changes nothing; else `new`, or `replaced`: the old row, its children and aliases go. children (key, seq, child) come
    with the record of that (key, seq); a repeated child is stored as often. Links of the old row are re-pointed at the
    new one; `links` (key, link_id) adds links, which point at the key's row, or at null until there is one.

    Aliases: the first claim, by (seq, key), of a name that is free has it. A name of a record that the batch replaces is
    free from that record's seq on; all others stay with their owners. row_id is a 64-bit hash of the batch and the
    key, so a rerun gives the same; it tells rows of one key apart and is never looked up without its key.
    The four tables are written from one outcome, which is a written table, and published at once.
    """
    number, listed = store.current()
    if batch in listed["batches"]:
        return None
    spark, n = store.spark, store.n
    names = F.coalesce("names", F.array().cast("array<string>"))
    order = F.struct("rank", "seq", F.to_json("body"), F.array_join(names, "\n"))
    came = records.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("rank", "seq", F.array_distinct(names).alias("names"), "body"), order).alias("n"))
    work = f"{store.root}/work/{batch}-{uuid.uuid4().hex}"
    came.write.parquet(f"{work}/came")
    came = spark.read.parquet(f"{work}/came")
    touched = _buckets(came, "key", n)
    old = store.table("records", listed, touched)
    if old is None:
        old = came.select("key", "n.rank", "n.seq", F.lit(0).cast("long").alias("row_id"), "n.names", "n.body").limit(0)
    was = old.select("key", F.struct("rank", "seq", "row_id", "names").alias("o"))
    outcome = F.when(F.col("o").isNull(), "new").when(F.col("o.rank") > F.col("n.rank"), "kept").otherwise("replaced")
    marked = came.join(was, "key", "left").withColumn("outcome", outcome)
    marked = marked.withColumn("row_id", F.when(F.col("outcome") == "kept", F.col("o.row_id")).otherwise(F.xxhash64(F.lit(batch), F.col("key").cast("string"))))
    marked.write.parquet(f"{work}/marked")
    marked = spark.read.parquet(f"{work}/marked")
    wins = marked.where("outcome <> 'kept'")
    changed = wins.select("key", "row_id", F.col("o.row_id").alias("gone"))

    fresh = wins.select("key", "n.rank", "n.seq", "row_id", "n.names", "n.body")
    store.write(batch, "records", old.join(changed.select("key"), "key", "left_anti").unionByName(fresh), touched, listed)

    # children of winners come, those of the rows that they replace go
    mine = children.join(wins.select("key", F.col("n.seq").alias("seq"), "row_id"), ["key", "seq"]).select("key", "row_id", "child")
    stored = store.table("children", listed, touched)
    if stored is not None:
        mine = stored.join(changed.select("key"), "key", "left_anti").unionByName(mine)
    store.write(batch, "children", mine, touched, listed)

    # links: new ones are added, all of touched keys point at the row that stands
    linked = touched if links is None else sorted({*touched, *_buckets(links.where("key IS NOT NULL"), "key", n)})
    rows = [x for x in (store.table("links", listed, linked), None if links is None else links.where("key IS NOT NULL").select("key", "link_id", F.lit(None).cast("long").alias("row_id"))) if x is not None]
    if rows:
        stand = store.table("records", listed, linked)
        # a null row_id or that of a replaced row: both take the row that stands now
        every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        store.write(batch, "links", every.select("key", "link_id").join(stand.select("key", "row_id"), "key", "left") if stand is not None else every, linked, listed)

    # aliases: names that old and new rows claim
    claims = wins.select(F.explode("n.names").alias("name"), "key", "row_id", F.col("n.seq").alias("seq")).where("name IS NOT NULL")
    freed = wins.where("o IS NOT NULL").select(F.explode("o.names").alias("name"), "key", F.col("n.seq").alias("free_at"))
    places = sorted({*_buckets(claims, "name", n), *_buckets(freed.where("name IS NOT NULL"), "name", n)})
    held = store.table("aliases", listed, places)
    if held is None:
        held = claims.select("name", "key", "row_id").limit(0)
    held = held.join(freed.select("name", "key", "free_at"), ["name", "key"], "left")
    owner = held.select("name", F.lit(True).alias("held"), "free_at")
    open_to = claims.join(owner, "name", "left").where("held IS NULL OR seq >= free_at")
    given = open_to.groupBy("name").agg(F.min(F.struct("seq", "key", "row_id")).alias("g")).select("name", "g.key", "g.row_id")
    given.write.parquet(f"{work}/given")
    given = spark.read.parquet(f"{work}/given")
    store.write(batch, "aliases", held.where("free_at IS NULL").select("name", "key", "row_id").unionByName(given), places, listed)

    counts = claims.groupBy("key").agg(F.count("*").alias("claimed")).join(given.groupBy("key").agg(F.count("*").alias("written")), "key", "left")
    result = marked.join(counts, "key", "left").select("key", "outcome", "row_id", F.col("o.row_id").alias("before"), F.coalesce("written", F.lit(0)).alias("aliases_written"), (F.coalesce("claimed", F.lit(0)) - F.coalesce("written", F.lit(0))).alias("aliases_dropped"))
    result.write.parquet(f"{work}/outcome")
    store.publish(number + 1, {**listed, "batches": [*listed["batches"], batch]})
    return spark.read.parquet(f"{work}/outcome")
