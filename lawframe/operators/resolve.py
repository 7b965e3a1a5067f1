"""Identifier resolution as joins on keys: prefixes, cascades and alternatives, never on LIKE or OR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def path_prefixes(path: Column) -> Column:
    """All cuts of /a/b/c: /a, /a/b, /a/b/c."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def longest_prefix(requests: DataFrame, request: str, units: DataFrame, path: str) -> DataFrame:
    """requests with `matched` (the longest stored path that is a prefix of the request, or null) and `exact`."""
    cuts = requests.select(request).distinct().select(request, F.posexplode(path_prefixes(F.col(request))).alias("cut", "prefix"))
    hits = cuts.join(units.select(F.col(path).alias("prefix")).distinct(), "prefix").groupBy(request).agg(F.max_by("prefix", "cut").alias("matched"))
    return requests.join(hits, request, "left").withColumn("exact", F.coalesce(F.col("matched") == F.col(request), F.lit(False)))


#: Pairs that a task of `any_of` makes, and the ways in which a value's left rows are dealt among tasks.
PAIRS, WAYS = 4_000_000, 64


def any_of(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]], keep: list[str]) -> DataFrame:
    """left joined with right where any of the equalities holds: a union of equi-joins, without repeats of `keep`.

    The result may be as many rows as left's times right's, so it is never shuffled to drop repeats. Each side has a row per
    different kept columns, with the values of each equality; a pair comes from the first equality that it meets, at the
    least value that meets it. Rows of a frequent value are dealt to as many tasks as its pairs ask for.
    """
    n = range(len(pairs))

    def side(rows: DataFrame, of: int) -> DataFrame:
        mine = [c for c in keep if c in rows.columns]
        values = rows.select(*mine, *(p[of].alias(f"_{of}{i}") for i, p in enumerate(pairs)))
        return values.groupBy(*mine).agg(*(F.array_sort(F.collect_set(f"_{of}{i}")).alias(f"_{of}{i}") for i in n))

    def meet(i: int) -> Column:
        a, b = F.col(f"_0{i}"), F.col(f"_1{i}")
        one = (F.size(a) == 1) & (F.size(b) == 1)
        return F.when(one, F.get(a, F.lit(0)) == F.get(b, F.lit(0))).otherwise(F.coalesce(F.arrays_overlap(a, b), F.lit(False)))

    def joined(i: int) -> DataFrame:
        a = sides[0].withColumn("_k", F.explode(f"_0{i}"))
        b = sides[1].withColumn("_k", F.explode(f"_1{i}"))
        made = a.groupBy("_k").agg(F.count("*").alias("x")).join(b.groupBy("_k").agg(F.count("*").alias("y")), "_k").agg(F.sum(F.col("x").cast("double") * F.col("y")), F.max(F.col("x").cast("double") * F.col("y"))).first()
        if (made[1] or 0) > PAIRS:
            a = a.withColumn("_way", F.pmod(F.xxhash64(*keep_of[0]), F.lit(WAYS)).cast("int"))
            b = b.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)))).hint("shuffle_hash")  # a task's share is small; the whole, repeated, is too much to broadcast
            a = a.repartition(int(min(made[0] // PAIRS + WAYS, 4000)), "_k", "_way")
        least = (F.size(f"_0{i}") == 1) | (F.size(f"_1{i}") == 1)
        first = F.when(least, F.lit(True)).otherwise(F.col("_k") == F.array_min(F.array_intersect(f"_0{i}", f"_1{i}")))
        d = a.join(b, [c for c in ("_k", "_way") if c in a.columns])
        return d.where(reduce(lambda x, y: x & y, [first, *(~meet(j) for j in range(i))])).select(*keep)

    sides = [side(left, 0), side(right, 1)]
    keep_of = [[c for c in keep if c in x.columns] for x in (left, right)]
    return reduce(DataFrame.union, map(joined, n))


def cascade(requests: DataFrame, lookups: list[tuple[DataFrame, list[str], str]], name: str) -> DataFrame:
    """requests with `name`: the value of the first lookup (table, key columns, value) that has the row's keys."""
    out = requests
    for i, (table, keys, value) in enumerate(lookups):
        out = out.join(table.select(*keys, F.col(value).alias(f"_v{i}")).dropDuplicates(keys), keys, "left")
    return out.withColumn(name, F.coalesce(*(F.col(f"_v{i}") for i in range(len(lookups))))).drop(*(f"_v{i}" for i in range(len(lookups))))


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows


def resolved(requests: DataFrame, units: DataFrame, aliases: DataFrame, numbered: DataFrame, parts: int | None = None) -> DataFrame:
    """(request, rule, path), a row per distinct request: the first of these that finds a unit, else rule `miss`.

    exact: a unit's path; alias: a name in aliases (alias, path); prefix: the longest leading part of the request that is a unit;
    number: the last segment as a section of the law in front of it, by numbered (key, path). All candidates of all
    requests are looked up in one equi-join, at most as many per request as it has segments and three: leading parts are
    asked for only at the numbers of segments that units have, which a first pass tells. parts: partitions of the shuffles.
    """
    text = F.col("request")
    split = F.split(text, "/")
    depths = sorted(r[0] for r in units.where("path IS NOT NULL").select(F.size(F.split("path", "/"))).distinct().collect())
    asked_for = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: (n >= 2) & (n < F.size(split)))
    cuts = F.transform(asked_for, lambda n: F.struct(F.lit("prefix").alias("rule"), (100 - n).alias("rank"), F.array_join(F.slice(split, 1, n), "/").alias("key")))
    one = lambda rule, rank, key: F.struct(F.lit(rule).alias("rule"), F.lit(rank).alias("rank"), key.alias("key"))
    wanted = F.concat(F.array(one("exact", 0, text), one("alias", 1, text)), cuts, F.array(one("number", 200, text)))
    asked = _dealt(requests.select("request"), parts, "request").distinct().withColumn("c", F.explode(wanted)).select("request", "c.*")
    known = units.select(F.explode(F.array(F.lit("exact"), F.lit("prefix"))).alias("rule"), F.col("path").alias("key"), "path").unionByName(aliases.select(F.lit("alias").alias("rule"), F.col("alias").alias("key"), "path")).unionByName(numbered.select(F.lit("number").alias("rule"), "key", "path"))
    hits = _dealt(asked, parts, "rule", "key").join(_dealt(known, parts, "rule", "key"), ["rule", "key"], "left")
    found = _dealt(hits.select("request", "rank", "path", "rule"), parts, "request").groupBy("request").agg(F.min(F.when(F.col("path").isNotNull(), F.struct("rank", "path", "rule"))).alias("m"))
    return found.select("request", F.coalesce("m.rule", F.lit("miss")).alias("rule"), F.col("m.path").alias("path"))


def parents(units: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, parent): the longest proper leading part of each path that is a unit itself; null for roots. parts: partitions of the shuffles.

    Most units' parent is the path without its last segment, so that is looked up first; only units without it ask for all shorter ones.
    """
    own = written(_dealt(units.select("path"), parts, "path").distinct(), "paths")
    key = own.select(F.col("path").alias("cut"), F.col("path").alias("parent"))
    cut = F.when(F.col("path").contains("/"), F.regexp_extract("path", "(?s)^(.*)/", 1))
    near = written(_dealt(own.withColumn("cut", cut), parts, "cut").join(_dealt(key, parts, "cut").hint("shuffle_hash"), "cut", "left").select("path", "parent"), "parents")
    rest = near.where("parent IS NULL").select("path")
    split = F.split("path", "/")
    cuts = F.when(F.size(split) > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(split) - 2, F.lit(1))), lambda n: F.array_join(F.slice(split, 1, n), "/")))
    asked = rest.select("path", F.explode(cuts).alias("cut"))
    found = asked.join(key, "cut").groupBy("path").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return near.where("parent IS NOT NULL").unionByName(rest.join(found, "path", "left"))
