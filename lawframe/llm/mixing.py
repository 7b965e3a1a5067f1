"""Mixing sources to target weights: a low-discrepancy schedule over shuffled blocks of equally many words.

1. `targets`: each source's share of `total_share` times all words by weight; a source is held to `max_repeat` times
   its own words and what is over goes to the others by weight (water filling in closed form: sources are taken by
   cap / weight, and the water level is where the remaining words meet the remaining weight).
2. `schedule`: slot t has the point frac(t * golden ratio) as a 32-bit integer, mapped through the sources' cumulative
   targets; slots are ranked per source; rank r takes block r mod n of pass r div n of that source's n blocks.
3. `blocks`: a source's documents in the order of md5(doc_id) lie on a line of words, cut every `block` words.
4. `mix`: joins the scheduled blocks with the pieces of documents in them and adds up the words taken.

Only DataFrame operations. No step puts a source in one task: documents are dealt by (source, piece of the hash),
slots by (source, run of slots), both with running totals over the small tables of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, small, word_count, written

WEIGHTS = (5, 2, 1)
GRID = 1 << 32
GOLDEN = 2654435769  # 2**32 / golden ratio, odd: every 32-bit point comes once before any comes again
CELLS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words; a null text has none."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target, start, end): start and end are the source's part of the 32-bit grid.

    One row per source; sources in the order of their bytes, null last, get the weights in turn. No words at all: targets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("k", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(total_share)))
    per = per.withColumn("caps_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level_here", (F.col("total") - F.coalesce("caps_before", F.lit(0.0))) / F.col("weight_left"))
    per = per.withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level_here"), F.struct(F.col("cap") / F.col("weight"), F.col("k"), F.col("level_here").alias("v")))).over(every)["v"])
    per = per.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
    line = Window.orderBy("k")
    per = per.withColumn("upto", F.sum("target").over(line)).withColumn("all", F.sum("target").over(every))
    grid = lambda c: F.when(F.col("all") > 0, F.floor(c / F.col("all") * F.lit(float(GRID)))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("end", F.when(F.col("k") == F.max("k").over(every), F.lit(GRID)).otherwise(grid(F.col("upto"))))
    per = per.withColumn("start", F.coalesce(F.lag("end").over(line), F.lit(0).cast("long")))
    return per.select("source", F.col("k").cast("long").alias("k"), "source_size", "weight", "target", "start", "end")


def golden_point(slot: Column) -> Column:
    """(slot * GOLDEN) mod 2**32, without a product beyond 63 bits."""
    low = F.pmod(slot, F.lit(GRID))
    return F.pmod(F.pmod(F.floor(low / 65536) * F.lit(GOLDEN), F.lit(GRID)) * 65536 + F.pmod(low, F.lit(65536)) * F.lit(GOLDEN), F.lit(GRID))


def schedule(sources: DataFrame, slots: int, run: int = 4096) -> DataFrame:
    """(slot, k, rank): the source, by its number k, and the rank within it of each of `slots` slots."""
    spark = sources.sparkSession
    width = GRID // CELLS
    parts = sources.where(F.col("end") > F.col("start")).select("k", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    drawn = points.join(parts, (points["cell"] == parts["cell"]) & (F.col("point") >= F.col("start")) & (F.col("point") < F.col("end"))).select("slot", "k", F.floor(F.col("slot") / run).alias("run"))
    counts = drawn.groupBy("k", "run").agg(F.count("*").alias("n"))
    before = counts.select("k", "run", (F.sum("n").over(Window.partitionBy("k").orderBy("run")) - F.col("n")).alias("before"))
    local = drawn.withColumn("local", F.row_number().over(Window.partitionBy("k", "run").orderBy("slot")) - 1)
    return local.join(before, ["k", "run"]).select("slot", "k", (F.col("before") + F.col("local")).alias("rank"))


def blocks(sizes: DataFrame, block: int, salt: str = "") -> DataFrame:
    """sizes with row, at, first_block, last_block: where each document lies on its source's line of words.

    Repeated rows are documents of their own; `row` tells them apart within (k, piece).
    """
    order = ["shuffle", "doc_id", "size"]
    d = sizes.withColumn("shuffle", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt))))
    d = d.withColumn("piece", F.substring("shuffle", 1, 3))
    w = Window.partitionBy("k", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("row", F.row_number().over(Window.partitionBy("k", "piece").orderBy(*order))).withColumn("inner", F.sum("size").over(w) - F.col("size"))
    totals = sizes.select("k", "size", F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt))), 1, 3).alias("piece")).groupBy("k", "piece").agg(F.sum("size").alias("words"))
    before = totals.select("k", "piece", (F.sum("words").over(Window.partitionBy("k").orderBy("piece")) - F.col("words")).alias("before"))
    d = d.join(before, ["k", "piece"]).withColumn("at", F.col("before") + F.col("inner"))
    return d.withColumns({"first_block": F.floor(F.col("at") / block), "last_block": F.floor((F.col("at") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)}).drop("shuffle", "before", "inner")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, max_repeat: int = 2, block_words: int = 64) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of docs (doc_id, text, source; others are ignored).

    taken: words of the document in the mix, repeats counted, at most max_repeat times its size; a source's sum of taken is
    within a few blocks, of block_words words, of its target. Null text: size 0. Null source: a source of its own. Empty table: no rows.
    """
    sizes = written(sized(docs), "sizes")
    sources = written(targets(sizes, weights, total_share, max_repeat), "sources")
    wanted = (sources.agg(F.sum("source_size")).first()[0] or 0) * min(total_share, max_repeat)
    block = block_words
    slots = int(-(-wanted // block))
    by_source = small(sources.select(F.col("source").alias("of"), "k", "source_size", "target"))
    lying = blocks(sizes.join(by_source, sizes["source"].eqNullSafe(F.col("of"))).drop("of"), block)
    per_pass = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1))
    taken = schedule(sources, slots).join(small(sources.select("k", "source_size")), "k").where(F.col("rank") < per_pass * max_repeat)
    taken = taken.groupBy("k", (F.col("rank") % per_pass).alias("b")).agg(F.count("*").alias("times"))
    pieces = lying.withColumn("b", F.explode(F.sequence("first_block", "last_block")))
    words = F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * block) - F.greatest(F.col("at"), F.col("b") * block)
    pieces = pieces.withColumn("words", words)
    key = ["k", "piece", "row", "doc_id", "source", "size", "source_size", "target"]
    joined = pieces.join(taken, ["k", "b"], "left")
    return joined.groupBy(*key).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("k", "piece", "row")


def copies(docs: DataFrame, **options) -> DataFrame:
    """docs repeated as the mix takes them: a document comes round(taken / size) times, with the columns of docs.

    A document that has words and comes no time drops out; one without words, or with a null doc_id, drops out too. Rows
    with one doc_id are taken as equal: each comes as often as the one of them that the mix takes most.
    """
    counts = mix(docs, **options).where(F.col("size") > 0).select("doc_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("_times")).where(F.col("_times") > 0)
    counts = counts.groupBy("doc_id").agg(F.max("_times").alias("times"))
    again = carried(docs, "doc_id").join(counts, "doc_id").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return again.select("row.*")
