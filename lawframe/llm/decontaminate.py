"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one scan of each text.

Words are runs without ASCII characters other than digits and letters, A-Z in lower case. A window is `size` consecutive
words of an item; an item of fewer words, but not none, is one window. The automaton's letters are words: each word of the
items has a character of its own and all other words share one, so a text becomes a string with a character per word and
an end of a match is the place of a word. Words in hits are mapped back to code points of the original text.

Items are cut into overlapping segments and dealt over parts of at most MOST_WORDS words and MOST_BYTES bytes, which is
checked; what is gathered and broadcast at once is one part. All but huge benchmarks have one part, so each text is
scanned once. With more, the scan of a part hands its findings to the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, written
from .license import lowered, spaced

#: What one automaton may hold: words of items, and their bytes.
MOST_WORDS, MOST_BYTES = 500_000, 16_000_000
#: Windows that begin in one segment of an item.
SEGMENT = 1000
#: Bytes to bytes: A-Z in lower case, other ASCII characters but digits and a-z to a blank.
NORMAL = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

FOUND = "n_words long, ranges array<struct<first:int,last:int>>, items array<string>"
_built: dict[str, Scanner] = {}


class Scanner:
    """The automaton of a part: (item id or None, words) segments."""

    def __init__(self, segments: list[tuple[str | None, list[str]]], size: int):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.items: list[set[str]] = []
        self.automaton = ahocorasick.Automaton()
        known: dict[str, int] = {}
        for item, words in segments:
            said = "".join([self.letters.setdefault(w.encode(), chr(0x10000 + len(self.letters))) for w in words])
            for i in range(max(1, len(said) - size + 1)):
                window = said[i : i + size]
                if window not in known:
                    known[window] = len(self.items)
                    self.items.append(set())
                    self.automaton.add_word(window, (known[window], len(window)))
                if item is not None:
                    self.items[known[window]].add(item)
        if known:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the ranges of words (first, last) that lie in windows, and the items that these belong to."""
        words = text.translate(NORMAL).split()
        if not self.items or not words:
            return len(words), [], set()
        letter = self.letters.get
        ranges: list[tuple[int, int]] = []
        seen = set()
        for end, (window, n) in self.automaton.iter("".join([letter(w, "\0") for w in words])):
            seen.add(window)
            first = end - n + 1
            while ranges and ranges[-1][1] >= first - 1:
                first = min(first, ranges.pop()[0])
            ranges.append((first, end))
        return len(words), ranges, set().union(*(self.items[w] for w in seen))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def code_points(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Where ranges of words stand in the text itself: code points, end exclusive."""
    if not ranges:
        return []
    is_word = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]])))
    starts, ends = edges[::2], edges[1::2]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(before[starts[a]]), "stop": int(before[ends[b]])} for a, b in ranges]


def segments(items: DataFrame, size: int) -> DataFrame:
    """(item, words, n_bytes): each item's words, cut so that every window lies in one segment; items without words drop out."""
    words = F.filter(F.split(spaced(lowered(F.coalesce("text", F.lit("")))), " "), lambda w: w != "")
    d = items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)), F.lit(SEGMENT))
    d = d.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(SEGMENT + size - 1)))).alias("words"))
    return d.withColumn("n_bytes", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w)))


def parts(items: DataFrame, size: int, most_words: int, most_bytes: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """The segments of the items, in as many parts as the bounds need; one part at a time comes to the driver."""
    table = written(segments(items, size), "items")
    n = 1
    while True:
        dealt = table.withColumn("part", F.pmod(F.xxhash64("words", "item"), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("part").agg(F.sum(F.size("words")).alias("words"), F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        over = sizes.where((F.col("n") > 1) & ((F.col("words") > most_words) | (F.col("bytes") > most_bytes))).limit(1).count()
        if not over or n >= 1 << 20:
            break
        n *= 2
    for k in range(n):
        yield [(r["item"], r["words"]) for r in dealt.where(F.col("part") == k).select("item", "words").collect()]


def scanning(broadcast, size: int):
    """A vectorised function of (text in UTF-8, findings of earlier parts or null) to FOUND. A worker keeps one automaton, that of its last part."""
    name = uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        if name not in _built:
            _built.clear()
            _built[name] = Scanner(broadcast.value, size)
        scanner, rows = _built[name], []
        for text, old, had in zip(texts, earlier["ranges"], earlier["items"], strict=True):
            n, ranges, items = scanner.scan(bytes(text))
            if len(old):
                ranges = merged(ranges + [(r["first"], r["last"]) for r in old])
            rows.append((n, [{"first": a, "last": b} for a, b in ranges], sorted(items.union(had))))
        return pd.DataFrame(rows, columns=["n_words", "ranges", "items"])

    return scan


def found(docs: DataFrame, items: DataFrame, size: int = 10, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(row, n_words, n_hit, items, ranges), a row per row of docs; row is the whole input row, whatever its columns are called.

    n_hit: words inside any occurrence of a window; items: distinct ids of items with such windows, as strings, sorted;
    ranges: (first, last) words of the maximal runs of hit words, from 0. `spans` maps them to the text.
    Null or empty text: no words. Items with a null id count as windows, without an id to name; items of one id are one
    item; null and empty items have no windows. No items: nothing is hit. No rows: no rows.
    """
    d = carried(docs, F.coalesce("text", F.lit("")).alias("_text"))
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first:int,last:int>>").alias("ranges"), F.array().cast("array<string>").alias("items"))
    out = d.withColumn("_f", none)
    for k, part in enumerate(parts(items, size, most_words, most_bytes)):
        if k:
            out = written(out, "scanned")
        scan = scanning(docs.sparkSession.sparkContext.broadcast(part), size)
        out = out.withColumn("_f", scan(F.col("_text").cast("binary"), "_f"))
    n_hit = F.aggregate("_f.ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return out.select("row", "_f.n_words", n_hit.alias("n_hit"), "_f.items", "_f.ranges")


def spans(hits: DataFrame) -> DataFrame:
    """`found`'s rows with words in hits, and `spans`: (start, stop) code points of the original text per range."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def places(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([code_points(bytes(t), [(x["first"], x["last"]) for x in r]) for t, r in zip(texts, ranges, strict=True)])

    hit = hits.where("n_hit > 0")
    return hit.withColumn("spans", places(F.coalesce("row.text", F.lit("")).cast("binary"), "ranges"))


def oracle() -> str:
    """DuckDB SQL for the rows of the query: every run of words of each length that windows have, joined with them."""
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    leads = ", ".join(f"lead(x, {i}) OVER o" for i in range(1, 10))
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
p AS (SELECT r, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS s FROM d),
t AS (SELECT r, s, n, [x, {leads}] AS ws FROM p WINDOW o AS (PARTITION BY r ORDER BY s)),
m AS (SELECT t.r, t.s, g.k, g.item_id FROM (SELECT DISTINCT k FROM g) l JOIN t ON t.s + l.k - 1 <= t.n JOIN g ON g.k = l.k AND g.g = array_to_string(t.ws[1:l.k], ' ')),
h AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS w FROM (SELECT DISTINCT r, s, k FROM m)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""
