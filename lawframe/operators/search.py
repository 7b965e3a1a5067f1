"""Keyword search over term counts: all words, phrases, BM25. Terms are runs of ASCII letters and digits in lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = "[a-z0-9]+"


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): a row per document and term; documents without terms have none."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({TERM})"))
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def holding_all(terms: DataFrame, key: str, words: list[str]) -> DataFrame:
    return terms.where(F.col("term").isin(words)).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(words))).select(key)


def holding_phrase(docs: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Documents in which the words stand one after another."""
    between = "[^a-z0-9]+"
    return docs.where(F.lower(text).rlike(f"(^|[^a-z0-9]){between.join(words)}($|[^a-z0-9])"))


def bm25(docs: DataFrame, key: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold any of the words; lengths and frequencies come from all documents.

    A row's words are counted where it is read: what is shuffled is its length and a count for each word, not its terms.
    """
    words = list(dict.fromkeys(words))
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({TERM})"))
    count = lambda w: F.size(F.filter("_t", lambda t: t == w))
    own = docs.select(key, terms.alias("_t")).select(key, F.size("_t").alias("dl"), *(count(w).alias(f"tf{i}") for i, w in enumerate(words)))
    tfs = [f"tf{i}" for i in range(len(words))]
    counts = own.groupBy(key).agg(*(F.sum(c).alias(c) for c in ["dl", *tfs])).where("dl > 0")
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.count_if(F.col(c) > 0).alias(f"df{i}") for i, c in enumerate(tfs)))
    score = F.lit(0.0)
    for i, c in enumerate(tfs):
        tf, df = F.col(c), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score += F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("mean")))).otherwise(0.0)
    hold = counts.where(F.col(key).isNotNull() & (F.greatest(*tfs, F.lit(0)) > 0))
    return hold.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))
