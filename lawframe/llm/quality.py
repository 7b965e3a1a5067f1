"""Quality rules: what a document's own words and lines show, and lines that many documents of a host share.

Own figures (`figures`): words are runs without ASCII white space. A text of null counts as one without words.
  word_chars, n_symbols, n_dup_lines, n_repeat_words, and base_failed (under 10 words, or over a fifth of them repeated).
Cross-document line frequency (`common_lines`, `judge`): lines are normalised (trimmed, lower case, digits as 0, runs of
  white space as one blank) and hashed; a line is common at a host (the source) if over max(least_docs, share * the host's
  documents) distinct documents there hold it. Common lines are removed (`without_common_lines`); a document is rejected
  as depleted if under `keep_share` of its words are left.

Only DataFrame operations. A line of a document is one row of (host, line, doc_id) hashes, dealt by all three, and then added
up per host in partial counts, so a line that a third of all rows hold has no task of its own; only lines over the limit are
joined back: with L lines a document, a host has fewer than L / share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, carried, small, written

WINDOW = 5


def _repeat_words(pairs: Column) -> Column:
    """Words within a window that occurs twice or more. pairs: (h, i), each window's hash and place, sorted; a plain column,
    as the lambda looks at neighbours and an expression would be evaluated anew for each element.

    Windows with an equal neighbour count; each such place adds the words that the place before it doesn't cover.
    """
    alike = lambda x, j: F.coalesce(x["h"] == F.get(pairs, j)["h"], F.lit(False))
    near = F.transform(pairs, lambda x, j: F.when(alike(x, j + 1) | alike(x, j - 1), x["i"]))
    at = F.sort_array(F.filter(near, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def figures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col("text"), F.lit(""))
    names = docs.columns
    d = docs.withColumns({"_w": F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long")})
    # each word's hash once, then a window's hash from five of them
    d = d.withColumns({"_h": F.transform("_w", lambda w: F.xxhash64(w)), "word_chars": F.length(F.array_join("_w", "")).cast("long"), "n_words": F.size("_w").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")}).drop("_w", "_l")
    h = F.col("_h")
    # the last four windows would run over the end: they are cut off, their hashes are of nulls
    hashes = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
    d = d.withColumn("_g", F.slice(hashes, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))).drop("_h")
    g = F.col("_g")
    d = d.withColumn("_p", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    d = d.withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("_p")), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return d.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"{BLANK}+", " "))


def common_lines(docs: DataFrame, share: float = 0.05, least_docs: int = 25) -> DataFrame:
    """(host, line, docs): lines that over max(least_docs, share * documents of the host) distinct documents of the host hold."""
    d = docs.select(F.col("source").alias("host"), F.col("doc_id").alias("id"), "text")
    hosts = d.select("host", "id").distinct().groupBy(F.col("host").alias("of")).agg(F.count("*").alias("host_docs"))
    lines = F.array_distinct(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(normalised(x))))
    held = d.select("host", "id", F.explode(lines).alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["of"])).where(F.col("docs") > F.col("host_docs") * share).select("host", "line", "docs")


def _per_host(docs: DataFrame, share: float, least_docs: int) -> DataFrame:
    """(of, common): the common lines of each host that has any, as one array, so that documents aren't exploded."""
    common = common_lines(docs, share, least_docs).groupBy(F.col("host").alias("of")).agg(F.collect_list("line").alias("common"))
    return small(written(common, "host-lines"))


def _judged(d: DataFrame, per_host: DataFrame, keep_share: float) -> DataFrame:
    """d (text, source and others) with the columns of `figures`, n_common_words, kept and left_text."""
    d = d.join(per_host, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    is_common = lambda x: F.array_contains(F.col("common"), F.xxhash64(normalised(x)))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    d = figures(d).withColumn("gone", F.when(F.col("common").isNotNull(), F.filter(lines, is_common)))
    d = d.withColumn("n_common_words", F.coalesce(F.aggregate("gone", F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD))), F.lit(0)).cast("long"))
    left = F.when(F.size("gone") > 0, F.array_join(F.filter(lines, lambda x: ~is_common(x)), "\n")).otherwise(F.col("text"))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= F.col("n_words") * F.lit(keep_share)))
    return d.withColumn("left_text", left).drop("common", "gone")


def judge(docs: DataFrame, share: float = 0.05, least_docs: int = 25, keep_share: float = 0.2) -> DataFrame:
    """(row, text, source, the columns of `figures`, n_common_words long, kept boolean, left_text), one row per row of docs;
    row is the whole input row, whatever its columns are called; left_text is the text without common lines.

    Null text, empty text: no words, base_failed, not kept. Null source: a host of its own. Rows with one doc_id are one
    document to the counts (null: one as well), and are judged alike.
    """
    return _judged(carried(docs, "text", "source"), _per_host(docs, share, least_docs), keep_share)


def without_common_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents kept, with the columns of docs, their texts without the host's common lines; n_chars, where there is one, follows the text.

    The verdicts are written first: a filter on them would be pushed below, and the whole expression of the figures put in
    its place many times over.
    """
    kept = written(judge(docs, **options).select("row", "left_text", "kept"), "judged").where("kept")
    kind = dict(docs.dtypes)
    value = lambda c: F.col("left_text") if c == "text" else F.length("left_text").cast(kind[c]) if c == "n_chars" else F.col(f"row.`{c}`")
    return kept.select(*(value(c).alias(c) for c in docs.columns))
