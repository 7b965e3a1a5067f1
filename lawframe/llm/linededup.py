"""Line dedup over levelled sorted runs of line hashes.

A run is a table (line, docs, last_doc), bucketed and sorted by `line`: how many documents of a batch hold the line, and
the largest doc_id of those. `LineRuns.add` takes a batch of documents, makes one row per distinct line of it and
merge-anti-joins it with the runs: lines that no run holds are the batch's own run, of level 0, so that a line is in one
run only; for lines that a run holds, the batch's figures go to the `repeats`, which are sorted runs as well. When a level
has `fanout` runs they are merged into one of the next level (`compact`). A line's figures are those of its run and its
repeats (`totals`).

`drop_repeats` uses the runs to drop lines that many documents share: the last holder (largest doc_id) keeps its lines.
All steps are DataFrame operations. A hot line is one row per document in a batch and is counted in partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, bucketed, carried, removed, swept, unbucketed, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key_of(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case; other letters as they are."""
    return F.translate(F.regexp_replace(line, rf"^{BLANK}+|{BLANK}+$", ""), UPPER, UPPER.lower())


def hash_of(key: Column) -> Column:
    """128 bits of a key: two texts with one hash are not to be expected in any corpus."""
    return F.unhex(F.md5(key))


def long_lines(text: Column, least_chars: int) -> Column:
    """Hashes of the distinct keys of at least least_chars code points in a text."""
    long = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(x) >= least_chars)
    keys = F.filter(F.transform(long, key_of), lambda k: F.length(k) >= least_chars)
    return F.array_distinct(F.transform(keys, hash_of))


class LineRuns:
    """Levelled sorted runs in the shared folder. Held here: only the lists of tables, by level."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels, self.repeats, self.last = spark, fanout, [], [], None

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(bucketed(run.select("line", "docs", "last_doc"), f"run{level}", "line", ["line"]))
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merges the runs of a level, which share no line, into one run of the next."""
        merging = self.levels[level]
        self.levels[level] = []
        self._put(reduce(DataFrame.unionByName, map(unbucketed, merging)), level + 1)
        for run in merging:
            removed(run)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (line, doc_id), a row per document and distinct line. Returns the run of the lines that are new, and adds it.

        Tables that others stand for leave the disk: a batch once its lines are in its run or the repeats, merged runs and
        repeats. The run that is returned is a table of its own until the next call.
        """
        if self.last is not None:
            removed(self.last)
            self.last = None
        run = bucketed(batch.groupBy("line").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_doc")), "batch", "line", ["line"])
        known = self.runs
        if not known:
            self._put(run, 0)
            self.last = run
            return run
        fresh = reduce(lambda d, r: d.join(r.select("line").hint("merge"), "line", "left_anti"), known, run)
        fresh = bucketed(fresh, "fresh", "line", ["line"])
        self.repeats.append(bucketed(run.join(fresh.select("line").hint("merge"), "line", "left_anti"), "repeats", "line", ["line"]))
        removed(run)
        if len(self.repeats) >= self.fanout:
            merging, self.repeats = self.repeats, [bucketed(merged(self.repeats), "repeats", "line", ["line"])]
            for table in merging:
                removed(table)
        self._put(fresh, 0)
        self.last = fresh
        return fresh

    def totals(self) -> DataFrame:
        """(line, docs, last_doc) over all runs and repeats."""
        return merged(self.runs + self.repeats)

    def clear(self) -> None:
        """All tables leave the disk; totals read before are no longer to be had."""
        last = [] if self.last is None else [self.last]
        for table in self.runs + self.repeats + last:
            removed(table)
        self.levels, self.repeats, self.last = [], [], None
        swept(self.spark)


def merged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(unbucketed, runs)).groupBy("line").agg(F.sum("docs").alias("docs"), F.max("last_doc").alias("last_doc"))


def line_table(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, line): a row for each document and distinct long line in it. Repeated rows of a doc_id count once."""
    return docs.select("doc_id", F.explode(long_lines(F.col("text"), least_chars)).alias("line"))


def shared_lines(table: DataFrame, least_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """(line, docs, last_doc): the lines that at least least_docs documents of table (doc_id, line; no row twice) hold, counted batch by batch in the runs, as a written table."""
    runs = LineRuns(table.sparkSession, fanout)
    for b in range(batches):
        runs.add(table.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    shared = written(runs.totals().where(F.col("docs") >= least_docs), "shared", ["line"])
    runs.clear()
    return shared


def drop_repeats(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text), one row per row of docs; row is the whole input row, whatever its columns are called.

    A line whose key (see key_of) has least_chars code points or more and is in least_docs documents or more goes, with all
    its places in a document, except in the document with the largest doc_id that holds it. Other lines stay, joined by \\n.
    Null or empty text: one empty line. A null doc_id is never the last holder; rows with one doc_id are one document.
    """
    table = written(line_table(docs.select("doc_id", "text"), least_chars).distinct(), "lines")
    shared = shared_lines(table, least_docs, batches, fanout)
    gone = table.join(shared, "line").where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("doc_id").agg(F.collect_list("line").alias("gone")).withColumnRenamed("doc_id", "of")
    d = carried(docs, "doc_id", "text")
    d = d.join(gone, d["doc_id"].eqNullSafe(gone["of"]), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    stay = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(x) < least_chars) | ~F.array_contains(F.col("gone"), hash_of(key_of(x)))))
    d = d.select("row", lines.alias("lines"), stay.alias("stay"))
    return d.select("row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("kept_text"))


def without_shared_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with its columns, the text without the lines that `drop_repeats` drops; n_chars, where there is one, follows the text."""
    left = drop_repeats(docs, **options)
    kind = dict(docs.dtypes)
    value = lambda c: F.col("kept_text") if c == "text" else F.length("kept_text").cast(kind[c]) if c == "n_chars" else F.col(f"row.`{c}`")
    return left.select(*(value(c).alias(c) for c in docs.columns))
