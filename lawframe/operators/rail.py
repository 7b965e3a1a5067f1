"""Trees of units by path: nested spans, counts below, and the part of a tree that a page beside a unit lists.

units (law, path, level, seq): paths begin with the law's and are unique in it; seq is the order of the document, in which
a unit stands before all below it, of any type that can be ordered. A unit's parent is its longest leading part that is a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below_law(law: Column, path: Column) -> Column:
    """All cuts of a path that are longer than its law's: /law/a, /law/a/b; none where the path doesn't lie below the law."""
    rest = F.filter(F.split(F.substr(path, F.length(law) + 1), "/"), lambda x: x != "")
    cuts = F.transform(F.filter(F.sequence(F.lit(0), F.size(rest)), lambda n: n > 0), lambda n: F.concat(law, F.lit("/"), F.array_join(F.slice(rest, 1, n), "/")))
    return F.when(path.startswith(F.concat(law, F.lit("/"))), cuts).otherwise(F.array().cast("array<string>"))


def spans(units: DataFrame) -> DataFrame:
    """units with `parent`, `depth` (1 at the top), `last`, `below` and `sections`: the unit and all below it are those with seq from
    seq to last, of which `below` lie below and `sections` are sections below it.

    Each unit counts for all its cuts in one partial aggregate, so a law with most of the units meets in no task; a second
    join on (law, cut) keeps the cuts that are units.
    """
    cuts = units.select("law", "path", "seq", (F.col("level") == "section").cast("int").alias("s"), F.explode(below_law(F.col("law"), F.col("path"))).alias("cut"))
    own = F.col("path") == F.col("cut")
    sums = cuts.groupBy("law", "cut").agg(F.max("seq").alias("last"), F.count_if(~own).alias("below"), F.coalesce(F.sum(F.when(~own, F.col("s"))), F.lit(0)).alias("sections"))
    nodes = units.select("law", "path", "level", "seq").join(sums.withColumnRenamed("cut", "path"), ["law", "path"])
    above = cuts.where(~own).select("law", "path", "cut").join(nodes.select("law", F.col("path").alias("cut")), ["law", "cut"]).groupBy("law", "path")
    return nodes.join(above.agg(F.max_by("cut", F.length("cut")).alias("parent"), F.count("*").alias("n")), ["law", "path"], "left").withColumn("depth", F.coalesce("n", F.lit(0)) + 1).drop("n")


def beside(nodes: DataFrame, asked: DataFrame, limit: int = 300) -> DataFrame:
    """(law, current, path, level, seq, depth, below, open) for each of asked (law, current): what stands in the tree beside `current`.

    A law of at most `limit` units lists all. A larger one lists its top units and the children of the units around
    `current` and of itself, down to the first section, whose children are not listed. open: `current` is the unit or
    lies below it (in a large law, sections are never open). A null or foreign `current` opens nothing. nodes: of `spans`.
    """
    sizes = nodes.groupBy("law").agg((F.count("*") > limit).alias("large"))
    asked = asked.select("law", "current").distinct().join(sizes, "law")
    all_of = asked.where("NOT large").select("law", "current").join(nodes, "law")
    large = asked.where("large").select("law", "current")
    around = large.withColumn("cut", F.explode(below_law(F.col("law"), F.col("current")))).join(nodes.select("law", F.col("path").alias("cut"), F.col("level").alias("l"), F.col("depth").alias("d")), ["law", "cut"])
    closed = around.groupBy("law", "current").agg(F.min(F.when(F.col("l") == "section", F.col("d"))).alias("closed"))
    parents = around.join(closed, ["law", "current"]).where("closed IS NULL OR d < closed").select("law", "current", F.col("cut").alias("parent"))
    some = large.join(nodes.where("parent IS NULL"), "law").unionByName(parents.join(nodes, ["law", "parent"]))
    within = (F.col("current") == F.col("path")) | F.col("current").startswith(F.concat("path", F.lit("/")))
    opens = lambda df, also: df.select("law", "current", "path", "level", "seq", "depth", "below", F.coalesce(within & also, F.lit(False)).alias("open"))
    return opens(all_of, F.lit(True)).unionByName(opens(some, F.col("level") != "section"))
