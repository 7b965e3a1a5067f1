"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontaminate import oracle as decontaminate_oracle
from .fim import oracle as fim_oracle
from .license import oracle as license_oracle


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(documents(spark, sf_dir)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find

    return digest(find(documents(spark, sf_dir)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_repeats

    return drop_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    return encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, predict, prototypes

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return predict(docs, prototypes(docs.where(~held_out(F.col("doc_id")))))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dartminhash import classes

    return classes(documents(spark, sf_dir).select("doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import without_repeats

    return without_repeats(documents(spark, sf_dir)).drop("kept")


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .aq import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut and reordered, with digests of the output and of the text rebuilt from it."""
    from .fim import restored, transformed

    d = transformed(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return d.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that arrived before May 2024 written by time, then the layout rewritten for all clicks; a row per final file."""
    from .timeparts import file_table, moved, new_folder, write_layout

    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    old = F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"), F.lit(False))
    moment, limit, folder = moved(F.col("ts"), F.col("click_id")), 1 + clicks.count() // 500, new_folder(spark, "op12")
    how = {"moment": moment, "order": [moment, F.col("arrived_at"), F.col("click_id")], "id_": F.col("click_id"), "limit": limit}
    start = write_layout(clicks.where(old), folder, **how)
    final = write_layout(clicks, folder, **how, fresh=~old, there=start)
    return file_table(spark, final, start, clicks.columns)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scanned for windows of ten words of the benchmark's items."""
    from .decontaminate import found

    d = found(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_license, op3_quality, op4_language, op5_near_dedup, op6_pii, op7_line_dedup, op8_mixing, op9_suffix_dedup, op10_additive_quantisation, op11_fill_in_middle, op12_time_partitions, op13_decontamination)}

ORACLE: dict[str, str] = {
    "op10_additive_quantisation": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_license": license_oracle(),
    "op11_fill_in_middle": fim_oracle(),
    "op13_decontamination": decontaminate_oracle(),
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id <> s.last_doc) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL OR k.doc_id = s.last_doc), '')) AS kept_sha256
FROM k LEFT JOIN s ON k.key = s.key GROUP BY k.doc_id""",
}
