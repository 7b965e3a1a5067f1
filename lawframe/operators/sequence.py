"""Order-dependent operators as windows: rank, islands, forward fill, markers, neighbours, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str | Column]


def numbered(df: DataFrame, keys: list[str], order: Cols, name: str = "n") -> DataFrame:
    """Row number within keys: occurrence numbers, renumbering, keep-first."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, keys: list[str], order: Cols) -> DataFrame:
    """The first row of each key in the order."""
    return numbered(df, keys, order, "_n").where("_n = 1").drop("_n")


def islands(df: DataFrame, keys: list[str], at: str, step: int = 1, name: str = "island") -> DataFrame:
    """Numbers runs in which `at` goes up by `step`."""
    w = Window.partitionBy(*keys).orderBy(at)
    starts = F.coalesce((F.col(at) - F.lag(at).over(w) != step).cast("int"), F.lit(0))
    return df.withColumn("_s", starts).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def filled_forward(df: DataFrame, keys: list[str], order: Cols, value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def marked_islands(df: DataFrame, keys: list[str], order: Cols, marker: Column, name: str = "island") -> DataFrame:
    """Numbers the stretches that begin with a marker; what lies before the first is 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(marker.cast("int")).over(w))


def number_conflicts(claims: DataFrame, series: str, number: str, seq: str) -> DataFrame:
    """claims with fits, kept, out_of_sequence.

    A number claimed once in its series is clean. A claim fits if it lies strictly between the nearest clean numbers before
    and after it. Of the claims of a number the first that fits is kept, else the first. A clean claim that doesn't fit is
    out of sequence.
    """
    w = Window.partitionBy(series).orderBy(seq)
    d = claims.withColumn("claims", F.count("*").over(Window.partitionBy(series, number)))
    clean = F.when(F.col("claims") == 1, F.col(number))
    d = d.withColumn("_before", F.last(clean, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_after", F.first(clean, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    d = d.withColumn("fits", F.coalesce(F.col("_before") < F.col(number), F.lit(True)) & F.coalesce(F.col("_after") > F.col(number), F.lit(True)))
    pick = Window.partitionBy(series, number).orderBy(F.col("fits").desc(), seq)
    d = d.withColumn("kept", F.row_number().over(pick) == 1).withColumn("out_of_sequence", (F.col("claims") == 1) & ~F.col("fits"))
    return d.drop("_before", "_after")


def folded(order_key: Column, items: Column, later) -> Column:
    """Newest by a partial order: a fold over the items in their order that changes only to what `later` says is later.

    A group's items meet in one task, as a partial order allows no partial aggregate; for a total one see `newest`.
    """
    rows = F.array_sort(F.collect_list(F.struct(order_key.alias("k"), items.alias("v"))))
    values = F.transform(rows, lambda r: r["v"])
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: F.when(later(x, a), x).otherwise(a))


def newest(at: Column, order_key: Column, item: Column) -> Column:
    """`folded` with a later `at` as later: the item of the greatest `at`, of equal ones that of the smallest (long) order_key, in partial aggregates.

    As in the fold, nothing is later than a first item without `at`, and no other item without `at` is later than any.
    """
    greatest = F.max_by(item, F.when(at.isNotNull(), F.struct(at, -order_key)))
    first = F.min_by(F.struct(at.alias("at"), item.alias("item")), order_key)
    return F.when(first["at"].isNull(), first["item"]).otherwise(greatest)
