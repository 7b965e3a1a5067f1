"""Whether later laws have changed a law: three kinds of evidence in one pass, and the newest by an order that is only partial."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shares, small, written

# Kinds of evidence, in the order in which they are looked at.
EVIDENCE = ("source_credit", "classification", "compilation")
# Up to so many rows of a key are folded as one array, without Python.
FEW = 64
FACTS = "identifier string, kind string, congress int, number int, date date"


def later(a, b):
    """a is later than b, both structs of FACTS as columns or as rows: by congress and number where both have them and their
    series can be compared (of one kind, or of different congresses), else by date where both have one, else not."""
    if not isinstance(a, Column):
        if a["identifier"] == b["identifier"]:
            return False
        if None not in (a["congress"], a["number"], b["congress"], b["number"]) and (a["kind"] == b["kind"] or a["congress"] != b["congress"]):
            return (a["congress"], a["number"]) > (b["congress"], b["number"])
        return None not in (a["date"], b["date"]) and a["date"] > b["date"]
    has = lambda x: x["congress"].isNotNull() & x["number"].isNotNull()
    series = has(a) & has(b) & (a["kind"].eqNullSafe(b["kind"]) | (a["congress"] != b["congress"]))
    by_number = F.struct(a["congress"], a["number"]) > F.struct(b["congress"], b["number"])
    return ~a["identifier"].eqNullSafe(b["identifier"]) & F.when(series, by_number).otherwise(F.coalesce(a["date"] > b["date"], F.lit(False)))


def beats(a: dict, b: dict) -> bool:
    """Whatever b is later than, a is later than too, and than b: one series with a higher number and no earlier date, or two dates without numbers."""
    numbers = [None not in (x["congress"], x["number"]) for x in (a, b)]
    dates = [x["date"] is not None for x in (a, b)]
    if all(numbers) and a["kind"] == b["kind"] and (a["congress"], a["number"]) > (b["congress"], b["number"]):
        return not any(dates) or (all(dates) and a["date"] >= b["date"])
    return not any(numbers) and all(dates) and a["date"] > b["date"]


def shortened(rows: list[dict]) -> list[dict]:
    """Rows, in order, over which a fold of `later` gives the same as over all, whatever it starts from: of two neighbours one of which beats the other, that one stays.

    The order is partial and need not be transitive, so rows that aren't neighbours can't stand for each other.
    """
    kept: list[dict] = []
    for row in rows:
        while kept and beats(row, kept[-1]):
            kept.pop()
        if not kept or not beats(kept[-1], row):
            kept.append(row)
    return kept


def newest(rows: DataFrame, key: str) -> DataFrame:
    """(key, newest, n): the fold over each key's rows in the order of `place`, which keeps its newest so far unless the next is later; rows: (key, place, c), c a struct of FACTS; n counts distinct laws.

    Each law counts where it stands first. Keys with at most FEW rows are folded as arrays. rows should be a written table, as it is read three times.

    Of the others repeats go in partial aggregates. Rows are then dealt by ranges of (key, place) and each task shortens its stretch of a key, a key's first
    row apart; what is left of a key is folded as it streams through one task, which holds a row of it at a time.
    """
    kind = dict(rows.dtypes)
    many = small(written(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(F.col(key).alias("_many")), "many"))
    short = rows.join(many, F.col(key) == F.col("_many"), "left_anti").where(F.col(key).isNotNull()).repartition(shares(rows), key)
    short = short.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("_rows")).select(key, _folded(F.col("_rows")).alias("_f"))
    short = short.select(key, "_f.newest", "_f.n")
    rows = rows.join(many, F.col(key) == F.col("_many"), "left_semi")
    once = rows.groupBy(key, F.col("c.identifier").alias("_i")).agg(F.min(F.struct("place", "c")).alias("m")).select(key, "m.place", "m.c.*")
    facts = ["identifier", "kind", "congress", "number", "date"]

    def by_key(batches: Iterator[pd.DataFrame], step, done) -> Iterator[pd.DataFrame]:
        """A frame per batch of the rows that `done` gives for each finished key's state, which `step` carries on."""
        name, state = None, None
        for b in batches:
            out: list[dict] = []
            for row in b.astype(object).where(b.notna(), None).to_dict("records"):
                if state is not None and name != row[key]:
                    out += done(state)
                    state = None
                name, state = row[key], step(state, row)
            if out:
                yield pd.DataFrame(out)
        if state is not None:
            yield pd.DataFrame(done(state))

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def step(state, row):
            first, rest, n = state or (None, [], 0)
            if first is None:
                return row, rest, 1
            while rest and beats(row, rest[-1]):
                rest.pop()
            if not rest or not beats(rest[-1], row):
                rest.append(row)
            return first, rest, n + 1

        yield from by_key(batches, step, lambda s: [{**s[0], "seen": s[2]}, *({**r, "seen": 0} for r in s[1])])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = lambda state, row: (row if state is None or later(row, state[0]) else state[0], (state[1] if state else 0) + row["seen"])
        yield from by_key(batches, step, lambda s: [{key: s[0][key], **{f: s[0][f] for f in facts}, "n": s[1]}])

    parts = once.repartitionByRange(key, "place").sortWithinPartitions(key, "place").mapInPandas(shorten, f"`{key}` {kind[key]}, place {kind['place']}, {FACTS}, seen long")
    best = parts.repartition(key).sortWithinPartitions(key, "place").mapInPandas(fold, f"`{key}` {kind[key]}, {FACTS}, n long")
    return short.unionByName(best.select(key, F.struct(*facts).alias("newest"), "n"))


def _folded(rows: Column) -> Column:
    """struct(newest, n) of an array of (place, c) in order, as `newest` says."""
    ids = F.transform(rows, lambda r: F.struct(r["c"]["identifier"]))
    firsts = F.filter(rows, lambda r, i: F.array_position(ids, F.struct(r["c"]["identifier"])) == i + 1)
    fold = lambda xs: F.aggregate(xs, F.get(xs, F.lit(0))["c"], lambda best, x: F.when(later(x["c"], best), x["c"]).otherwise(best))
    return F.get(F.transform(F.array(firsts), lambda xs: F.struct(fold(xs).alias("newest"), F.size(xs).cast("long").alias("n"))), F.lit(0))


def decided(laws: DataFrame, aliases: DataFrame, evidence: DataFrame, covered: DataFrame) -> DataFrame:
    """(law, status, latest, latest_label, evidence, candidates), a row per law.

    laws: FACTS; aliases: (law, identifier); evidence: (law, source, place, c), source one of EVIDENCE, c a struct of FACTS;
    covered: (law) of those that some source covers. A candidate fires if it is later than the law and not the law under
    any of its names. known_amended if any fires, with the newest in the order of EVIDENCE and place; else no_record for a
    covered law that isn't private, else unknown. candidates: distinct laws that fire.
    """
    law = laws.select(F.col("identifier").alias("law"), F.struct(*laws.columns).alias("l"))
    named = aliases.select("law", F.col("identifier").alias("_alias"))
    fires = evidence.join(law, "law").where(later(F.col("c"), F.col("l"))).join(named, (named["law"] == evidence["law"]) & (named["_alias"] == F.col("c.identifier")), "left_anti")
    rank = F.array_position(F.array(*map(F.lit, EVIDENCE)), F.col("source")).cast("int")
    fires = written(fires.select("law", rank.alias("rank"), F.struct(rank.alias("rank"), F.col("place").alias("at")).alias("place"), "c"), "fires")
    kinds = fires.groupBy("law").agg(*(F.bool_or(F.col("rank") == i).alias(e) for i, e in enumerate(EVIDENCE, 1)))
    d = law.join(kinds, "law", "left").join(newest(fires.drop("rank"), "law"), "law", "left").join(covered.select("law").distinct().withColumn("_covered", F.lit(True)), "law", "left")
    status = F.when(F.col("newest").isNotNull(), "known_amended").when(F.col("_covered") & ~F.col("l.kind").eqNullSafe(F.lit("pvtl")), "no_record").otherwise("unknown")
    said = F.array_join(F.array_compact(F.array(*(F.when(F.col(e), F.lit(e)) for e in EVIDENCE))), ",")
    return d.select("law", status.alias("status"), F.col("newest.identifier").alias("latest"), label(F.col("newest")).alias("latest_label"), said.alias("evidence"), F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))


def label(c: Column) -> Column:
    """Public Law 81-740, Private Law 81-5, or the date of an act; else the identifier."""
    name = F.when(c["kind"] == "pl", "Public Law ").when(c["kind"] == "pvtl", "Private Law ")
    numbered = F.concat(name, c["congress"].cast("string"), F.lit("-"), c["number"].cast("string"))
    return F.when(c.isNotNull(), F.coalesce(numbered, F.concat(F.lit("Act of "), F.date_format(c["date"], "MMMM d, yyyy")), c["identifier"]))
