"""Volumes of laws, XML files of any size, as rows of laws and units, read by many tasks.

Spark's text reader deals a file out by byte ranges and gives records that end with a law's end tag, so no task reads a
whole file (but a compressed file is one range). What a record needs of those before it, its number and the last page that
they show, comes from a light pass that leaves a row per range (`starts`), and then from range to range's end as its records
are walked one after the other. So nothing of a law is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.identity import identity
from ..functions.units import LAW, walked

END = "</pLaw>"
PLACE = ["file", "block", "row"]


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, head, xml): a row per law; head is what stands between it and the law before."""
    raw = spark.read.option("lineSep", END).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    start = F.regexp_instr("value", F.lit(r"<pLaw[\s>]"))
    return raw.withColumn("start", start).where("start > 0").select(*PLACE, F.expr("left(value, start - 1)").alias("head"), F.concat(F.expr("substring(value, start)"), F.lit(END)).alias("xml"))


def last_page(text: Column) -> Column:
    return F.lower(F.try_element_at(F.regexp_extract_all(text, F.lit(r'<page\b[^>]*\bidentifier="[^"]*?([^"/]+)/?"')), F.lit(-1)))


def shown(read: DataFrame) -> DataFrame:
    """Records with the last page in their head and the last one in all of them, null where none is shown."""
    return read.withColumn("page_in_head", last_page(F.col("head"))).withColumn("page_shown", F.coalesce(last_page(F.col("xml")), "page_in_head"))


def starts(read: DataFrame) -> DataFrame:
    """A row per range, (file, block, laws_before, page_before, volume): how many records of its file come before it, the last page that they show, and the file's volume: as it says, else by its name, else 0."""
    said = F.nullif(F.regexp_extract("head", r"<volume>\s*([0-9]+)\s*</volume>", 1), F.lit("")).try_cast("int")
    named = F.regexp_extract("file", r"([0-9]+)[^0-9/]*$", 1).try_cast("int")
    light = shown(read).select(*PLACE, said.alias("said"), "page_shown")
    last = F.max(F.when(F.col("page_shown").isNotNull(), F.struct("row", "page_shown")))["page_shown"]
    each = light.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("said").alias("said"), last.alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("laws_before"), F.last("last", ignorenulls=True).over(before).alias("page_before"),
                       F.coalesce(F.max("said").over(Window.partitionBy("file")), named, F.lit(0)).alias("volume"))


def laws(spark: SparkSession, path: str) -> DataFrame:
    """A row per law: file, law (from 1), volume, page_before, what LAW has, enacted, and `is` (see identity).

    A record that can't be read has its `error` and no units; the laws around it are as they would be without it.
    """

    schema = StructType.fromDDL(f"file string, {LAW}, law int, page_before string, volume int")
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, law, page = None, -1, 0, None
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out = []
                for r in b.slice(at, 200).to_pylist():
                    if (r["file"], r["block"]) != now:
                        now, last, law, page = (r["file"], r["block"]), -1, r["laws_before"], r["page_before"]
                    if r["row"] <= last:
                        raise ValueError(f"records of {now} are out of order")
                    last, law = r["row"], law + 1
                    out.append({"file": r["file"], "law": law, "page_before": r["page_in_head"] or page, "volume": r["volume"]} | walked(r["xml"]))
                    page = r["page_shown"] or page
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    read = records(spark, path)
    # a broadcast leaves a range's records in one task, in their order
    placed = shown(read).join(F.broadcast(starts(read)), ["file", "block"])
    d = placed.select(*PLACE, "page_in_head", "page_shown", "laws_before", "page_before", "volume", "xml").mapInArrow(walk, schema)
    d = d.withColumns({"congress": F.col("congress").try_cast("int"), "enacted": F.substring(F.trim("approved"), 1, 10).try_cast("date")})
    d = d.withColumn("is", identity(F.col("doc_type"), F.col("doc_number"), F.col("congress"), F.col("public_private"), F.col("enacted"), F.col("note"), F.col("hrefs"), F.col("preface")))
    return d


def units(laws: DataFrame) -> DataFrame:
    """A row per unit of laws that have an identifier: file, law, identifier (the law's and the unit's path), and what a unit has; a unit before its law's first page is on the last page before it."""
    d = laws.where("error IS NULL AND is.primary IS NOT NULL").select("file", "law", "is.primary", "page_before", F.explode("units").alias("u"))
    whole = lambda path: F.concat("primary", path)
    above = F.transform("u.ancestors", lambda a: F.struct(whole(a["path"]).alias("identifier"), a["level"].alias("level"), a["num"].alias("num"), a["heading"].alias("heading")))
    return d.select("file", "law", whole(F.col("u.path")).alias("identifier"), "u.occurrence", whole(F.col("u.parent")).alias("parent_identifier"), "u.level", "u.num", "u.heading", "u.seq", "u.depth",
                    above.alias("ancestors"), F.coalesce("u.first_page", "page_before").alias("first_page"), "u.pages", "u.text", "u.content_hash")
