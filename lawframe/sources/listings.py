"""Listings and paged answers saved as JSON files, and archives of numbered members, as tables. Paths may be globs and need only be Spark's."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "files array<struct<name:string,folder:boolean,link:string,justFileName:string,displayLabel:string,formattedLastModifiedTime:string,size:long>>"
BILLS = "bills array<struct<congress:int,number:string,type:string,title:string,latestAction:struct<actionDate:string,text:string>,laws:array<struct<number:string,type:string>>>>"
PACKAGE = r"^PLAW-([0-9]+)(publ|pvtl)([0-9]+)\.(xml|zip)$"


def whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file with the columns of schema, `file`, and `error`: the text that is no JSON of that schema, else null."""
    return spark.read.schema(f"{schema}, error string").option("columnNameOfCorruptRecord", "error").option("mode", "PERMISSIVE").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(congress, kind, number, name, link, modified, size) of the law files in saved listings; folders and other files drop out."""
    f = whole_json(spark, path, FILES).select(F.explode("files").alias("f")).where("NOT coalesce(f.folder, false)")
    part = lambda i: F.regexp_extract("f.justFileName", PACKAGE, i)
    f = f.where(F.col("f.justFileName").rlike(PACKAGE))
    return f.select(part(1).cast("int").alias("congress"), part(2).alias("kind"), part(3).cast("int").alias("number"), F.col("f.justFileName").alias("name"), F.col("f.link").alias("link"), F.try_to_timestamp("f.formattedLastModifiedTime", F.lit("dd-MMM-yyyy HH:mm")).alias("modified"), F.col("f.size").alias("size"))


def pending(spark: SparkSession, path: str) -> DataFrame:
    """(congress, law, private, bill_type, bill_number, title, action_date): a row for each law of each bill in saved listings."""
    b = whole_json(spark, path, BILLS).select(F.explode("bills").alias("b")).select("b.*", F.explode("b.laws").alias("law"))
    return b.select("congress", F.col("law.number").alias("law"), F.lower("law.type").contains("private").alias("private"), F.lower("type").alias("bill_type"), F.col("number").alias("bill_number"), "title", F.col("latestAction.actionDate").try_cast("date").alias("action_date"))


def entries(spark: SparkSession, folder: str, items: str) -> DataFrame:
    """(congress, session, offset, place, item.*) of files entries-{congress}-{session}-{offset}.json; items: the struct's schema.

    Pages overlap or come twice without harm: of equal (congress, session, offset + place) one row stays.
    """
    name = lambda i: F.regexp_extract("file", r"entries-([0-9]+)-([0-9]+)-([0-9]+)\.json$", i).cast("int")
    pages = whole_json(spark, f"{folder}/entries-*.json", f"items array<struct<{items}>>, total long")
    rows = pages.select(name(1).alias("congress"), name(2).alias("session"), name(3).alias("offset"), "total", F.posexplode("items").alias("place", "item"))
    rows = rows.withColumn("place", F.col("offset") + F.col("place"))
    return rows.dropDuplicates(["congress", "session", "place"]).select("congress", "session", "place", "total", "item.*")


def members(spark: SparkSession, path: str, pattern: str = r"([0-9]+)\.xml$") -> DataFrame:
    """(archive, name, number, content, error) of the members of zip files whose name fits; number is the pattern's group.

    An archive that can't be read gives one row with its error. Archives are the unit of work: one is in one task.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for n in z.namelist():
                            if m := re.search(pattern, n):
                                yield pd.DataFrame([(path_, n, int(m[1]), z.read(n), None)], columns=["archive", "name", "number", "content", "error"])
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    yield pd.DataFrame([(path_, None, None, None, str(e))], columns=["archive", "name", "number", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "archive string, name string, number long, content binary, error string")
