"""Which law a record is: rules in order, of which the first that gives a number counts, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import roman

# Laws have numbers from this congress on; how a marginal note and a link give one.
FIRST_NUMBERED = 57
NOTE = r"(?i)\[?\s*(public|private)\s+la\w*\.?,?\s*(?:no\.?\s*)?([0-9][0-9,]*)"
LINK = r"^/us/(?:bill/[0-9]+/)?(pl|pvtl)/(?:[0-9]+/)?([0-9]+)$"


def doc_number(text: Column) -> Column:
    """3, [3] or a Roman numeral; null for anything else."""
    t = F.trim(text)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^\[?\s*([0-9]+)\s*\]?\.?$", 1), F.lit("")).try_cast("int"), roman(t))


def identity(doc_type: Column, number: Column, congress: Column, side: Column, enacted: Column, note: Column, hrefs: Column, preface: Column) -> Column:
    """struct(rule, kind, number, chapter, primary, aliases, warnings).

    Rules: `typed`, the record's type and number; `note`, the marginal note beside the title; `link`, a link in it; `flag`,
    the public or private flag with the record's number. The flag decides the kind for note and link. A law without a
    number, or of a congress before numbers began, is an act by date and chapter; one with neither is nothing (null
    primary). aliases: all its identifiers, the primary first.
    """
    t, flag = F.lower(F.trim(F.coalesce(doc_type, F.lit("")))), F.lower(F.trim(F.coalesce(side, F.lit(""))))
    n = doc_number(number)
    typed, is_chapter = t.isin("public law", "private law"), t == "chapter"
    of_flag = F.when(flag == "public", "pl").when(flag == "private", "pvtl")
    said = lambda i: F.nullif(F.regexp_extract(F.coalesce(note, F.lit("")), NOTE, i), F.lit(""))
    link = F.get(F.filter(hrefs, lambda h: F.trim(h).rlike(LINK)), F.lit(0))
    linked = lambda i: F.nullif(F.regexp_extract(F.trim(link), LINK, i), F.lit(""))
    noted = F.regexp_replace(said(2), ",", "").try_cast("int")
    by = lambda rule, kind, num: F.struct(F.lit(rule).alias("rule"), kind.alias("kind"), num.alias("number"))
    rules = (
        F.when(typed, by("typed", F.when(t == "public law", "pl").otherwise("pvtl"), n)),
        F.when(noted.isNotNull(), by("note", F.coalesce(of_flag, F.when(F.lower(said(1)) == "public", "pl").otherwise("pvtl")), noted)),
        F.when(link.isNotNull(), by("link", F.coalesce(of_flag, linked(1)), linked(2).try_cast("int"))),
        F.when(of_flag.isNotNull() & n.isNotNull() & ~is_chapter, by("flag", of_flag, n)),
    )
    chapter = F.when(is_chapter, n).otherwise(F.when(typed, F.nullif(F.regexp_extract(F.coalesce(preface, F.lit("")), r"(?i)\bchapter\s+([0-9]+)", 1), F.lit("")).try_cast("int")))
    read = F.struct(F.coalesce(*rules).alias("first"), chapter.alias("chapter"), of_flag.alias("of_flag"), F.coalesce(F.when(F.lower(said(1)) == "public", "pl").when(F.lower(said(1)) == "private", "pvtl"), linked(1)).alias("noted"))
    return F.get(F.transform(F.array(read), lambda r: _named(r, congress, enacted)), F.lit(0))


def _named(read: Column, congress: Column, enacted: Column) -> Column:
    """The answer from what the rules read, which is computed once."""
    first, chapter, of_flag = read["first"], read["chapter"], read["of_flag"]
    numbered = F.coalesce(first["number"].isNotNull() & (congress >= FIRST_NUMBERED), F.lit(False))
    law = F.when(numbered, F.concat(F.lit("/us/"), first["kind"], F.lit("/"), congress.cast("string"), F.lit("/"), first["number"].cast("string")))
    act = F.concat(F.lit("/us/act/"), F.date_format(enacted, "yyyy-MM-dd"), F.lit("/ch"), chapter.cast("string"))
    warnings = F.filter(F.array(
        F.when(first["number"].isNotNull() & ~numbered, "a number before numbers began"),
        F.when(first["rule"].isin("note", "link") & of_flag.isNotNull() & (of_flag != read["noted"]), "the note's kind is not the record's"),
        F.when(law.isNull() & act.isNull(), "nothing names the law"),
    ), lambda w: w.isNotNull())
    return F.struct(
        F.when(law.isNotNull(), first["rule"]).when(act.isNotNull(), "chapter").alias("rule"), F.when(law.isNotNull(), first["kind"]).when(act.isNotNull(), "act").alias("kind"),
        first["number"].alias("number"), chapter.alias("chapter"), F.coalesce(law, act).alias("primary"), F.filter(F.array(law, act), lambda x: x.isNotNull()).alias("aliases"), warnings.alias("warnings"))
