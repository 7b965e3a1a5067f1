"""License scans: phrases that stand in a text, and an exact set-similarity join of text blocks with licence templates.

A block that meets a template must also hold the words by which its licence is told from others (see NAMES, OTHERS): short
sentences differ in one word, and 0.8 of them is all but that.

Blocks are sets of words (see WORDS; A-Z in lower case): the lines of a text, and around each line break, for a notice
wrapped over lines, the words before and after it that a run across it can hold. A run for a template of n words has
n / threshold words at most, so a template's block has n / threshold - 1 words on each side, whatever further breaks lie
among them. A block meets a template if it holds at least `threshold` of the template's distinct words. The join is exact
and filtered:
- the templates' words are ordered by how many documents hold them, rarest first (counted over the whole table);
- prefix: with need = ceil(threshold * size), a block that meets a template holds one of its size - need + 1 first words;
- length: the block holds at least `need` words of the templates' vocabulary;
- positional: from the first prefix word on, in that order, the block still has `need` such words.
What passes is counted exactly. The templates are a fixed table of this module, so the join runs within each row and nothing
of the documents is shuffled; only the vocabulary's counts are gathered.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: BREAKS without the line feed.
INNER_BREAKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, text): sentences by which a licence is named or granted.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the License at apache org licenses LICENSE 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "Copyright. All rights reserved."),
    ("apache-2.0", "Released under the Apache License."),
    ("bsd", "Released under the BSD License."),
    ("mpl-2.0", "Released under the Mozilla Public License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *((label, f"SPDX-License-Identifier: {name}") for label, name in (("mit", "MIT"), ("apache-2.0", "Apache-2.0"), ("bsd", "BSD-3-Clause"), ("mpl-2.0", "MPL-2.0"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"))),
)

#: What tells a licence from its neighbours, by label: of these words a block must hold those that the template holds ...
NAMES = {"mit": "mit", "apache-2.0": "apache", "gpl": "gnu", "lgpl": "lesser", "cc-by": "cc by attribution", "cc-by-nc": "nc noncommercial", "cc-by-sa": "sa sharealike", "bsd": "bsd", "mpl-2.0": "mozilla mpl", "reserved": "reserved"}
#: ... and none of these.
OTHERS = {"cc-by": "nc noncommercial sa sharealike nd noderivatives", "cc-by-nc": "sa sharealike nd noderivatives", "cc-by-sa": "nc noncommercial nd noderivatives"}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, text.lower()) if w]


def lowered(text) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def spaced(low: Column) -> Column:
    """The words of a lowered text with one blank between."""
    return F.trim(F.regexp_replace(low, BREAKS, " "))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for label, t in templates for w in [*words_of(t), *OTHERS.get(label, "").split()]})


def telling(label: str, text: str) -> tuple[list[str], list[str]]:
    """The words that a block must hold, and those that it must not, to be of the template."""
    return sorted(set(words_of(text)) & set(NAMES.get(label, "").split())), OTHERS.get(label, "").split()


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Documents that hold each word of the templates; what reaches the driver has a row per template word at most."""
    words = F.array(*map(F.lit, vocabulary(templates)))
    held = F.array_intersect(words, F.split(spaced(lowered("text")), " "))
    return {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """docs' columns with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double).

    score: 1 where a base phrase stands, else the largest share of a template's words in a block that meets it, else 0.
    Null or empty text: no words, no labels ('') and null places. Repeated rows are scanned alike.
    """
    counts = frequencies(docs.select("text"), templates)
    order = sorted(vocabulary(templates), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    exact = Fraction(str(threshold))
    rows = []
    for label, text in templates:
        ranks = sorted({rank[w] for w in words_of(text)})
        need = max(1, math.ceil(exact * len(ranks)))
        must, no = ([rank[w] for w in ws] for ws in telling(label, text))
        rows.append((label, ranks, ranks[: len(ranks) - need + 1], need, must, no, max(1, math.ceil(len(words_of(text)) / exact) - 1)))
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    words = lambda xs: F.array(*map(F.lit, xs))
    table = F.array(*(F.struct(F.lit(lb).alias("label"), array(rs).alias("ranks"), array(pre).alias("prefix"), F.lit(need).alias("need"), array(must).alias("must"), array(no).alias("no"), F.lit(side).alias("side")) for lb, rs, pre, need, must, no, side in rows))
    gate = r"(?<![0-9a-z\x80-\x{10FFFF}])(?:" + "|".join(sorted({order[i - 1] for _, _, pre, *_ in rows for i in pre})) + r")(?![0-9a-z\x80-\x{10FFFF}])"

    d = docs.withColumn("_low", lowered(F.coalesce("text", F.lit(""))))
    d = d.withColumn("_norm", spaced(F.col("_low")))
    lines = F.when(F.col("_low").rlike(gate), F.filter(F.split("_low", "\n"), lambda x: x.rlike(gate)))
    rank_of = lambda w: F.array_position(words(order), w).cast("int")
    ranked = lambda x: F.array_sort(F.filter(F.transform(F.array_distinct(F.split(spaced(x), " ")), rank_of), lambda r: r > 0))
    d = d.withColumn("_blocks", F.transform(lines, ranked))

    def met(block_of) -> Column:
        def share(t: Column) -> Column:
            return once(block_of(t), lambda block: shared(t, block))

        def shared(t: Column, block: Column) -> Column:
            first = F.array_min(F.array_intersect(t["prefix"], block))
            may = (F.size(block) >= t["need"]) & (F.size(block) - F.array_position(block, first) + 1 >= t["need"])
            both = F.size(F.array_intersect(t["ranks"], block))
            told = (F.size(F.array_intersect(t["must"], block)) == F.size(t["must"])) & ~F.coalesce(F.arrays_overlap(t["no"], block), F.lit(False))
            return F.struct(t["label"].alias("label"), F.when(F.coalesce(may, F.lit(False)) & (both >= t["need"]) & told, both / F.size(t["ranks"])).alias("share"))

        return F.filter(F.transform(table, share), lambda m: m["share"].isNotNull())

    def across(ranks: Column, at: Column, side: Column) -> Column:
        """The ranks of up to `side` words on each side of the break after `at` words."""
        return F.slice(ranks, F.greatest(at - side, F.lit(0)) + 1, F.least(at, side) + side)

    def wrapped(parts: Column) -> Column:
        """What the blocks around the line breaks meet; parts: the words, with a line feed for each run of breaks between them."""
        ranks = F.transform(F.filter(parts, lambda x: x != "\n"), rank_of)
        places = F.filter(F.transform(parts, lambda x, i: F.when(x == "\n", i)), lambda i: i.isNotNull())
        firsts, most = array(sorted({i for _, _, pre, *_ in rows for i in pre})), F.lit(max(r[-1] for r in rows))
        held = lambda rs, at: lambda t: F.array_sort(F.filter(F.array_distinct(across(rs, at, t["side"])), lambda r: r > 0))
        near = lambda rs: F.filter(F.transform(places, lambda p, i: p - i), lambda at: F.arrays_overlap(across(rs, at, most), firsts))
        return once(ranks, lambda rs: F.flatten(F.transform(near(rs), lambda at: met(held(rs, at)))))

    parts = F.split(F.regexp_replace(F.regexp_replace(F.col("_low"), INNER_BREAKS, " "), " *\n[ \n]*", " \n "), " ")
    spans = F.when(F.col("_low").rlike(gate) & F.contains("_low", F.lit("\n")), once(F.filter(parts, lambda x: x != ""), wrapped))
    none = F.array().cast("array<struct<label:string,share:double>>")
    d = d.withColumn("_met", F.concat(F.coalesce(F.flatten(F.transform("_blocks", lambda b: met(lambda t: b))), none), F.coalesce(spans, none)))
    padded = F.concat(F.lit(" "), F.col("_norm"), F.lit(" "))
    places, firsts, lasts, names = [], [], [], []
    n_words = F.when(F.col("_norm") == "", F.lit(0)).otherwise(F.length("_norm") - F.length(F.replace(F.col("_norm"), F.lit(" "))) + 1)
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    for phrase, label in PHRASES.items():
        there = padded.contains(f" {phrase} ")
        places.append(F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)))
        firsts.append(F.when(there, blanks(F.substring_index(padded, f" {phrase} ", 1))))
        lasts.append(F.when(there, n_words - blanks(F.substring_index(padded, f" {phrase} ", -1)) - len(phrase.split())))
        names.append(F.when(there, F.lit(label)))
    base = F.array_sort(F.filter(F.array(*names), lambda x: x.isNotNull()))
    d = d.withColumns({"n_words": n_words.cast("long"), "n_base": sum(places[1:], places[0]).cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"), "_base": base})
    labels = F.array_sort(F.array_union("_base", F.transform("_met", lambda m: m["label"])))
    d = d.withColumns({"base_labels": F.array_join("_base", ","), "labels": F.array_join(labels, ",")})
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_met", lambda m: m["share"])), F.lit(0.0)))
    return d.withColumn("score", score).drop("_low", "_norm", "_blocks", "_met", "_base")


def oracle(threshold: float = 0.8, templates=TEMPLATES) -> str:
    """DuckDB SQL for the columns of `scan`, where no notice is wrapped: every line against every template."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    values = ", ".join(f"('{lb}', {quoted(sorted(set(words_of(t))))}, {quoted(telling(lb, t)[0])}::VARCHAR[], {quoted(telling(lb, t)[1])}::VARCHAR[], {max(1, math.ceil(Fraction(str(threshold)) * len(set(words_of(t)))))})" for lb, t in templates)
    breaks = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    at = lambda p: f"list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i+{len(p.split()) - 1}], ' ') = '{p}')"
    return f"""
WITH t(label, ws, must, others, need) AS (VALUES {values}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, low, list_filter(string_split_regex(low, '{breaks}'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, low, len(w) AS n, {", ".join(f"{at(p)} AS p{i}" for i, p in enumerate(PHRASES))} FROM w),
b AS (SELECT doc_id, n, flatten([p0, p1, p2]) AS ps, list_filter([CASE WHEN len(p0) > 0 THEN 'cc-by' END, CASE WHEN len(p1) > 0 THEN 'gpl' END, CASE WHEN len(p2) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS bl FROM p),
l AS (SELECT doc_id, list_distinct(string_split_regex(unnest(string_split(low, chr(10))), '{breaks}')) AS ws FROM d),
m AS (SELECT l.doc_id, t.label, len(list_intersect(t.ws, l.ws)) / len(t.ws) AS share FROM l, t WHERE len(list_intersect(t.ws, l.ws)) >= t.need AND len(list_intersect(t.must, l.ws)) = len(t.must) AND len(list_intersect(t.others, l.ws)) = 0),
g AS (SELECT doc_id, list(label) AS ml, max(share) AS share FROM m GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_base, list_min(ps) - 1 AS first_word, list_max(ps) - 1 AS last_word,
 array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ml, [])))), ',') AS labels,
 CASE WHEN len(ps) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN g ON b.doc_id = g.doc_id"""
