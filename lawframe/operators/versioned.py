"""Units of acts that come in several files, each in several versions: resolved as of a version, roots gathered from files.

files (prefix, file_id, partial_of): an act's files; partial_of is a title's designator, null for a file of the whole act.
versions (version_id, file_id, label, at, content_hash): the current one is the newest by (at, version_id).
units (version_id, path, level, section_num, seq): path is whole and begins with the act's prefix.
requests (prefix, path, through): path is what follows the prefix, empty for the act; through is a label, null for current versions.

All requests go through equi-joins. Versions are picked by aggregates, so a file with most of the versions meets in no
task; units are read for picked versions only. Rows of files, versions or units that repeat change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids

#: Fixed value: the place of a title whose designator is no number.
UNNUMBERED = 1000000


def pin(through: Column) -> Column:
    """The key of a label, with dashes of any kind alike; empty for the current version."""
    return F.when(through.isNull(), "").otherwise(F.concat(F.lit("="), F.regexp_replace(through, "–", "-")))


def title_order(partial_of: Column) -> Column:
    """(number, designator): Arabic or Roman value; other designators after all numbers, by text; null is an empty text."""
    text = F.trim(F.coalesce(partial_of, F.lit("")))
    digits = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.struct(F.coalesce(digits, ids.roman(text), F.lit(UNNUMBERED)).alias("number"), text.alias("designator"))


def picked(requests: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """(prefix, pin, file_id, partial_of, version_id, label, content_hash): the version of each file that (prefix, through) means.

    By label the highest version_id of that label; a file without one isn't there.
    """
    facts = F.struct("version_id", "label", "content_hash")
    by_label = versions.groupBy("file_id", pin(F.coalesce("label", F.lit(""))).alias("pin")).agg(F.max(facts).alias("v"))
    newest = versions.groupBy("file_id").agg(F.max(F.struct("at", "version_id", "label", "content_hash")).alias("v"))
    newest = newest.select("file_id", F.lit("").alias("pin"), F.struct("v.version_id", "v.label", "v.content_hash").alias("v"))
    wanted = requests.select("prefix", pin(F.col("through")).alias("pin")).distinct()
    of = wanted.join(files.select("prefix", "file_id", "partial_of").distinct(), "prefix")
    return of.join(by_label.unionByName(newest), ["file_id", "pin"]).select("prefix", "pin", "file_id", "partial_of", "v.*")


def roots(versions: DataFrame) -> DataFrame:
    """A row for each (prefix, pin) of `picked`: the whole-act file if there is one, else all files in title order.

    (file_id, version_id) are the first file's, n_files the number gathered, content_hash the file's, or the sha256 of all
    files' hashes joined by colons. The hashes of one act's files, 64 characters each, meet in a row; no text does.
    """
    whole = F.col("partial_of").isNull()
    place = F.struct(title_order(F.col("partial_of")).alias("title"), "file_id", "version_id", "content_hash")
    one = versions.groupBy("prefix", "pin").agg(F.min(F.when(whole, F.struct("file_id", "version_id", "content_hash"))).alias("w"), F.array_sort(F.collect_list(place)).alias("f"))
    digest = F.sha2(F.array_join(F.transform("f", lambda x: x["content_hash"]), ":"), 256)
    first = F.element_at("f", 1)
    has = F.col("w").isNotNull()
    return one.select("prefix", "pin", F.when(has, F.col("w.file_id")).otherwise(first["file_id"]).alias("file_id"), F.when(has, F.col("w.version_id")).otherwise(first["version_id"]).alias("version_id"), F.when(has, 1).otherwise(F.size("f")).alias("n_files"), F.when(has, F.col("w.content_hash")).otherwise(digest).alias("content_hash"))


def contents(versions: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of the gathered table of contents: (prefix, pin, number, designator, file_id, seq, path, level), in the order of these.

    The files are those of `roots`: an act with a whole-act file shows that one alone, the one with the smallest id.
    """
    whole = versions.groupBy("prefix", "pin").agg(F.min(F.when(F.col("partial_of").isNull(), F.col("file_id"))).alias("whole"))
    shown = versions.join(whole, ["prefix", "pin"]).where(F.coalesce(F.col("whole") == F.col("file_id"), F.lit(True)))
    shown = shown.select("prefix", "pin", "version_id", "file_id", title_order(F.col("partial_of")).alias("t"))
    return shown.join(units, "version_id").select("prefix", "pin", "t.number", "t.designator", "file_id", "seq", "path", "level").distinct()


def resolved(requests: DataFrame, files: DataFrame, versions: DataFrame, units: DataFrame) -> DataFrame:
    """A row for each distinct request: (prefix, path, through, resolution, served, version_id, provision, pinned).

    exact: the path is a unit, or lies below a section, which is served then, the rest in `provision`; prefix: its longest
    leading part that is a unit, at last the act; section_number: the section of that number anywhere in the act; miss: no
    file has such a version. Of several files' units that of the smallest version_id is served, then of the smallest seq.
    """
    asked = requests.select("prefix", "path", "through").distinct().withColumn("pin", pin(F.col("through")))
    chosen = picked(requests, files, versions)
    held = units.join(chosen.select("prefix", "pin", "version_id"), "version_id")
    unit = F.struct("version_id", "seq", F.col("path").alias("served"), "level")
    by_path = held.select("prefix", "pin", F.col("path").alias("key"), unit.alias("unit"))
    by_number = held.where("level = 'section' AND section_num IS NOT NULL").select("prefix", "pin", F.concat(F.lit("#"), "section_num").alias("key"), unit.alias("unit"))
    known = by_path.unionByName(by_number).groupBy("prefix", "pin", "key").agg(F.min("unit").alias("unit"))

    parts = ids.segments(F.col("path"))
    cuts = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda n: n > 0), lambda n: F.struct((F.size(parts) - n).alias("rank"), F.concat(F.col("prefix"), F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")).alias("key")))
    number = F.array(F.struct(F.lit(1 << 20).alias("rank"), F.concat(F.lit("#"), ids.section_number(F.col("path"))).alias("key")))
    tried = asked.withColumn("c", F.explode(F.concat(cuts, number))).select("prefix", "path", "through", "pin", "c.*")
    found = tried.join(known, ["prefix", "pin", "key"]).groupBy("prefix", "path", "pin").agg(F.min(F.struct("rank", "unit")).alias("m"))

    request = asked.join(found, ["prefix", "path", "pin"], "left").join(roots(chosen).select("prefix", "pin", F.col("version_id").alias("root")), ["prefix", "pin"], "left")
    rank, below = F.col("m.rank"), ids.below_section(F.col("path"))
    full = F.concat(F.col("prefix"), F.lit("/"), F.array_join(parts, "/"))
    by_num, section = rank == 1 << 20, F.col("m.unit.level") == "section"
    resolution = F.when(F.col("root").isNull(), "miss").when(F.size(parts) == 0, "exact").when(rank.isNull(), "prefix").when(by_num, "section_number").when((rank == 0) | section, "exact").otherwise("prefix")
    provision = F.when(by_num & (below != ""), F.concat_ws("/", "m.unit.served", below)).when(~by_num & (rank > 0) & section, full)
    served = F.when(F.col("root").isNotNull(), F.coalesce("m.unit.served", "prefix"))
    return request.select("prefix", "path", "through", resolution.alias("resolution"), served.alias("served"), F.coalesce("m.unit.version_id", "root").alias("version_id"), provision.alias("provision"), F.col("through").isNotNull().alias("pinned"))
