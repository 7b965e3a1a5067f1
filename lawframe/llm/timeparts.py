"""Adaptive time partitions: rows in files by time, with finer leaves where there are more rows, rewritten where rows arrive.

Counting: each partition of the rows builds a nested trie of counts, year, month, day, hour, and `treeReduce` merges the
tries. This goes in two steps, so that a trie is small whatever the rows are: first years and months; then days and hours
of those months only that are above the limit, of which there are fewer than rows / limit. A depth-first walk emits the
leaves: runs of siblings folded together as long as they stay within the limit, and heavy hours. The trie of leaves has
fewer than rows / limit split nodes at each level and is broadcast; rows descend it to their leaf.

Writing: rows are dealt by ranges of (leaf, order) and sorted, into a written table with their running number; a leaf's
parts of `limit` rows are then known from the row counts of (leaf, range), so no leaf, however large, meets in one task.
Each part is one Parquet file, written by one task that reads its rows in order. Files whose leaf, part and rows are
there already stay; the rest is written, and only then are the files deleted that don't belong to the layout any more.
"""

from __future__ import annotations

import calendar
import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import removed, shared_dir, written

#: Of a year's, month's or day's children, the digits of their names; years have four.
WIDTH = (4, 2, 2, 2)
NULL_LEAF = "null"


def hour_of(moment: Column) -> Column:
    """Whole hours since 1970-01-01 00:00 of a timestamp without a zone."""
    return F.unix_date(moment.cast("date")).cast("long") * 24 + F.hour(moment)


def months_of(hours: np.ndarray) -> np.ndarray:
    """Months since January 1970 of hours."""
    return (hours // 24).astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)


def path_of(hour: int) -> tuple[int, int, int, int]:
    """Year, month, day and hour."""
    day = hour // 24
    month = int(np.int64(day).astype("datetime64[D]").astype("datetime64[M]").astype(np.int64))
    first = int(np.int64(month).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64))
    return month // 12 + 1970, month % 12 + 1, day - first + 1, hour % 24


# tries: nested dicts; a node without children is its count


def put(trie: dict, path: tuple, n: int) -> None:
    for step in path[:-1]:
        trie = trie.setdefault(step, {})
    trie[path[-1]] = trie.get(path[-1], 0) + n


def merge(a: dict, b: dict) -> dict:
    """a with the counts of b. Associative and commutative."""
    for k, v in b.items():
        a[k] = merge(a.get(k, {}), v) if isinstance(v, dict) else a.get(k, 0) + v
    return a


def total(node: dict | int) -> int:
    return sum(map(total, node.values())) if isinstance(node, dict) else node


def _counted(batches: Iterator[pa.RecordBatch], within: list[int] | None) -> Iterator[pa.RecordBatch]:
    """One row: the partition's trie, of years and months, or of the days and hours of the months in `within`."""
    counts: dict[int, int] = {}
    for b in batches:
        hours = b.column(0).drop_null().to_numpy(zero_copy_only=False)
        months = months_of(hours)
        values, ns = np.unique(months if within is None else hours[np.isin(months, within)], return_counts=True)
        for v, n in zip(values.tolist(), ns.tolist(), strict=True):
            counts[v] = counts.get(v, 0) + n
    trie: dict = {}
    for v, n in counts.items():
        put(trie, (v // 12 + 1970, v % 12 + 1) if within is None else path_of(v), n)
    yield pa.RecordBatch.from_pydict({"trie": [pickle.dumps(trie)]}, schema=pa.schema([("trie", pa.binary())]))


def reduced(hours: DataFrame, within: list[int] | None) -> dict:
    tries = hours.mapInArrow(partial(_counted, within=within), "trie binary").rdd.map(lambda r: pickle.loads(r[0]))
    return tries.treeReduce(merge, depth=3) if tries.getNumPartitions() else {}


def counting_trie(hours: DataFrame, limit: int) -> dict:
    """The trie of a column of hours; months within the limit have no children. Nulls aren't counted."""
    trie = reduced(hours, None)
    heavy = sorted((y - 1970) * 12 + m - 1 for y, months in trie.items() for m, n in months.items() if n > limit)
    for year, months in (reduced(hours, heavy) if heavy else {}).items():
        trie[year] |= months
    return trie


@dataclass
class Leaves:
    """names: of the leaves in time order; trie: the nested tree whose ends are numbers of leaves; leaf number len(names) is that of null moments."""

    names: list[str] = field(default_factory=list)
    trie: dict = field(default_factory=dict)


def members(path: tuple[int, ...], first: int, last: int) -> range:
    """The siblings below a path: all years from first to last, or all months, days or hours."""
    return (range(first, last + 1), range(1, 13), range(1, calendar.monthrange(path[0], path[1])[1] + 1) if len(path) == 2 else range(0), range(24))[len(path)]


def folded(trie: dict, limit: int) -> Leaves:
    """Depth-first walk: siblings in time order; one above the limit is split into its children, or an hour by itself; any other joins the run of the one before it if that stays within the limit."""
    out = Leaves()
    if not trie:
        return out
    first, last = min(trie), max(trie)

    def emit(path: tuple[int, ...], node: dict, run: list[int] | None) -> None:
        if run and run[2]:
            name = lambda k, at: f"{k:0{WIDTH[at]}d}"
            for k in range(run[0], run[1] + 1):
                node[k] = len(out.names)
            out.names.append("/".join([*(name(k, i) for i, k in enumerate(path)), f"{name(run[0], len(path))}-{name(run[1], len(path))}"]))

    def walk(path: tuple[int, ...], counts: dict, node: dict) -> None:
        run: list[int] | None = None
        for k in members(path, first, last):
            n = total(counts.get(k, 0))
            if run and n <= limit and run[2] + n <= limit:
                run[1:] = [k, run[2] + n]
                continue
            emit(path, node, run)
            run = [k, k, n]
            if n > limit and len(path) < 3:
                run = None
                walk((*path, k), counts[k], node.setdefault(k, {}))
        emit(path, node, run)

    walk((), trie, out.trie)
    return out


def leaf_of(leaves) -> Column:
    """A vectorised function from hours to leaf numbers: each distinct hour of a batch descends the broadcast trie once."""

    @F.pandas_udf("int")
    def descend(hours: pd.Series) -> pd.Series:
        trie, null = leaves.value
        codes, values = pd.factorize(hours)

        def leaf(hour: float) -> int:
            node = trie
            for step in path_of(int(hour)):
                node = node[step]
                if not isinstance(node, dict):
                    break
            return node

        found = np.array([*map(leaf, values), null], dtype=np.int32)  # code -1, that of nulls, is the last
        return pd.Series(found[codes])

    return descend


# files


@dataclass(frozen=True)
class Part:
    """One file of a layout. rows: digest of all its rows in order; fresh: rows that the caller marked."""

    leaf: str
    part: int
    n_rows: int
    fresh: int
    ids: str
    rows: str
    path: str = ""


def numbered(rows: DataFrame, moment: Column, order: list[Column], id_: Column, fresh: Column, limit: int) -> tuple[DataFrame, list[str]]:
    """A written table (row, leaf, at, id, fresh, h1, h2) and the leaves' names. `at` goes up with (leaf, order); its upper bits number the range of rows, its lower 33 count in it.

    Rows that are equal in `order` are set in order by hashes of all their columns, and equal rows by their places in the input, so that no group of equal rows meets in one range.
    """
    spark, hashed = rows.sparkSession, [rows[f"`{c}`"] for c in rows.columns]
    d = rows.select(F.struct(*hashed).alias("row"), hour_of(moment).alias("hour"), *(c.alias(f"o{i}") for i, c in enumerate(order)), id_.cast("string").alias("id"), fresh.alias("fresh"), F.xxhash64(*hashed).alias("h1"), F.xxhash64(F.lit(1), *hashed).alias("h2"))
    leaves = folded(counting_trie(d.select("hour"), limit), limit)
    sent = spark.sparkContext.broadcast((leaves.trie, len(leaves.names)))
    d = d.withColumn("leaf", leaf_of(sent)("hour")).withColumn("place", F.monotonically_increasing_id())
    keys = ["leaf", *(f"o{i}" for i in range(len(order))), "h1", "h2", "place"]
    d = d.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    d = d.select("row", "leaf", F.monotonically_increasing_id().alias("at"), "id", "fresh", "h1", "h2")
    return written(d, "timeparts"), [*leaves.names, NULL_LEAF]


def part_starts(table: DataFrame, limit: int) -> list[tuple[int, int, int]]:
    """(at, leaf, part) of each part's first row, in order: at most rows / limit more than there are leaves.

    From the row counts of (leaf, range): a window over these counts, which are as many as leaves and ranges.
    """
    counts = table.groupBy("leaf", F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    parts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    parts = parts.withColumns({"low": F.expr(f"(before + {limit - 1}) div {limit}"), "high": F.expr(f"(before + n - 1) div {limit}")})
    parts = parts.where("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    rows = parts.select((F.col("first") + F.col("k") * limit - F.col("before")).alias("at"), "leaf", (F.col("k") + 1).alias("part"))
    return sorted(tuple(r) for r in rows.collect())


def file_of(starts) -> Column:
    """A vectorised function from `at` to the number of the part."""

    @F.pandas_udf("int")
    def search(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts.value, at.to_numpy(), side="right") - 1, dtype="int32")

    return search


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, n, fresh, ids, rows) of rows sorted by file: a file's rows stream by, its hash states are all that is kept."""
    out: dict[str, list] = {"file": [], "n": [], "fresh": [], "ids": [], "rows": []}
    state: list | None = None

    def close() -> None:
        if state:
            for k, v in zip(out, [state[0], state[1], state[2], state[3].hexdigest(), state[4].hexdigest()], strict=True):
                out[k].append(v)

    for b in batches:
        files = b.column("file").to_numpy()
        ids, fresh = b.column("id").fill_null("").to_pylist(), b.column("fresh").to_numpy(zero_copy_only=False)
        hashes = np.stack([b.column("h1").to_numpy(), b.column("h2").to_numpy()], axis=1)
        cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
        for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
            if lo == hi:
                continue
            if state is None or state[0] != files[lo]:
                close()
                state = [int(files[lo]), 0, 0, hashlib.sha256(), hashlib.sha256()]
            state[3].update((("," if state[1] else "") + ",".join(ids[lo:hi])).encode())
            state[4].update(hashes[lo:hi].tobytes())
            state[1], state[2] = state[1] + hi - lo, state[2] + int(fresh[lo:hi].sum())
    close()
    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.int32()), ("n", pa.int64()), ("fresh", pa.int64()), ("ids", pa.string()), ("rows", pa.string())]))


def write_layout(rows: DataFrame, folder: str, moment: Column, order: list[Column], id_: Column, limit: int, fresh: Column | None = None, there: list[Part] = ()) -> list[Part]:
    """Writes the layout of rows into folder and returns its files, in order; `there` are the files of an earlier layout in it.

    moment: a timestamp without a zone, by which leaves are dealt; null moments have a leaf of their own. order: of the rows
    in a leaf. limit: rows of a file. id_: what `ids` digests, in file order, joined by commas; null as an empty text.
    Equal rows are all kept. No rows: no files. The list is as long as leaves and rows / limit, whatever the rows are.
    """
    spark = rows.sparkSession
    table, names = numbered(rows, moment, order, id_, F.lit(False) if fresh is None else fresh, limit)
    starts = part_starts(table, limit)
    if starts:
        sent = spark.sparkContext.broadcast(np.array([s[0] for s in starts], dtype=np.int64))
        filed = table.withColumn("file", file_of(sent)("at"))
        small = filed.select("file", "at", "id", "fresh", "h1", "h2").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "at").drop("at")
        digests = {r["file"]: r for r in small.mapInArrow(_digests, "file int, n long, fresh long, ids string, rows string").collect()}
    parts = [Part(names[leaf], part, d["n"], d["fresh"], d["ids"], d["rows"]) for (_, leaf, part), d in ((s, digests[i]) for i, s in enumerate(starts))]
    kept = {(p.leaf, p.part, p.n_rows, p.rows): p.path for p in there}
    paths = [kept.get((p.leaf, p.part, p.n_rows, p.rows), "") for p in parts]
    new = [i for i, path in enumerate(paths) if not path]
    if new:
        targets = np.full(len(parts), -1, dtype=np.int32)
        targets[new] = np.arange(len(new))
        at = spark.sparkContext.broadcast(targets)
        out = filed.withColumn("to", place_of(at)("file")).where("to >= 0")
        out = out.repartitionById(len(new), F.col("to")).sortWithinPartitions("at").select("row.*")
        target = f"{folder}/layout-{uuid.uuid4().hex}"
        out.write.option("maxRecordsPerFile", 0).parquet(target)
        for path in spark.read.schema(out.schema).parquet(target).inputFiles():
            paths[new[int(re.search(r"/part-(\d+)-[^/]*$", path)[1])]] = path
    delete(spark, [p.path for p in there if p.path not in set(paths)])
    removed(table)
    return [Part(p.leaf, p.part, p.n_rows, p.fresh, p.ids, p.rows, path) for p, path in zip(parts, paths, strict=True)]


def place_of(at) -> Column:
    @F.pandas_udf("int")
    def place(files: pd.Series) -> pd.Series:
        return pd.Series(at.value[files.to_numpy()])

    return place


def delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)


def file_table(spark: SparkSession, parts: list[Part], before: list[Part], columns: list[str]) -> DataFrame:
    """(leaf, part, n_rows, n_new, rewritten, columns, ids_sha256, path), a row per file of a layout that followed `before`."""
    had = {p.path for p in before}
    rows = [(p.leaf, p.part, p.n_rows, p.fresh, p.path not in had, ",".join(columns), p.ids, p.path) for p in parts]
    return spark.createDataFrame(rows, "leaf string, part long, n_rows long, n_new long, rewritten boolean, columns string, ids_sha256 string, path string")


def moved(ts: Column, id_: Column) -> Column:
    """Fixed by the query's contract: the moment of a click; a null id moves nothing."""
    k = F.crc32(id_.cast("string").cast("binary")) % 128
    back = (ts.cast("timestamp_ntz") - F.make_dt_interval((k + 6) * (k + 6) * (k + 6))).cast("timestamp_ntz")
    monday = F.trunc(ts.cast("date"), "week").cast("timestamp_ntz")
    return F.when(k < 16, back).when(k > 111, monday).otherwise(ts.cast("timestamp_ntz"))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lawframe/{name}-{uuid.uuid4().hex}"
