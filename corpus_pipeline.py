"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lawframe.llm import bpe, dartminhash, linededup, mixing, quality
from lawframe.llm.common import documents, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that too many documents of their source share.

    A null or empty text is rejected. A null source is a source of its own. Repeated rows are judged alike and stay or go
    together. n_chars follows the text. No rows: no rows.
    """
    return quality.without_common_lines(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one with the largest doc_id only. n_chars follows the text.

    All rows stay; a null text becomes an empty one. Rows with one doc_id are one document, a null one never keeps a shared line.
    """
    return linededup.without_shared_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest doc_id.

    Rows with a null doc_id, and texts without words, stay. Of rows that repeat a doc_id one stays.
    """
    return dartminhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 2 times. Those without words or with a null doc_id drop out."""
    return mixing.copies(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document of the mix, a row for each time it is taken; a null text has no ids."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe", tokenize)]

#: Near-dedup and BPE are not expressible in SQL; tests hold what each stage's rule says on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/lawframe/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
