"""Column builders for identifier paths, numerals, terms and labels; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The path grammar's roots.
LAW = r"^/us/(pl|pvtl)/([0-9]+)/([0-9]+)(/.*)?$"
ACT = r"^/us/act/([0-9]{4}-[0-9]{2}-[0-9]{2})/ch([0-9]+)(/.*)?$"
COMPILED = r"^/us/sComp/([0-9]+)/([0-9]+)(/.*)?$"
PAGE = r"^/us/stat/([0-9]+)/([0-9A-Za-z]+(?:-[0-9]+)?)$"


def normalized(path: Column) -> Column:
    """One leading slash, none at the end, no blanks around."""
    return F.concat(F.lit("/"), F.regexp_replace(F.trim(path), r"^/+|/+$", ""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def section_number(path: Column) -> Column:
    """The number of the first segment like s12, or null."""
    return F.nullif(F.regexp_extract(path, r"(?s)^(?:[^/]*/)*?s([0-9][^/]*)", 1), F.lit(""))


def below_section(path: Column) -> Column:
    """What stands below the section's segment, joined by /; empty if nothing."""
    rest = F.regexp_extract(path, r"(?s)^(?:[^/]*/)*?s[0-9][^/]*/(.*)$", 1)
    tidy = F.regexp_replace(F.regexp_replace(rest, "/{2,}", "/"), r"^/|/\z", "")
    return F.coalesce(F.when(rest.contains("//") | rest.startswith("/") | rest.endswith("/"), tidy).otherwise(rest), F.lit(""))


def parsed(path: Column) -> Column:
    """(kind, congress, number, enacted, chapter, rest): kind is pl, pvtl, act, comp, stat or null for what is no identifier."""
    group = lambda p, i: F.nullif(F.regexp_extract(path, p, i), F.lit(""))
    number = lambda p, i: group(p, i).try_cast("int")
    enacted = group(ACT, 1).try_cast("date")
    kind = F.when(path.rlike(LAW), F.regexp_extract(path, LAW, 1)).when(path.rlike(ACT) & enacted.isNotNull(), "act").when(path.rlike(COMPILED), "comp").when(path.rlike(PAGE), "stat")
    return F.struct(
        kind.alias("kind"),
        F.coalesce(number(LAW, 2), number(COMPILED, 1), number(PAGE, 1)).alias("congress"),
        F.coalesce(group(LAW, 3), group(COMPILED, 2), F.lower(group(PAGE, 2))).alias("number"),
        enacted.alias("enacted"),
        number(ACT, 2).alias("chapter"),
        F.coalesce(group(LAW, 4), group(ACT, 3), group(COMPILED, 3)).alias("rest"),
    )


#: Words that read as numerals and are none.
NO_NUMERALS = ("DIV", "MIX", "DIM")


def roman(text: Column) -> Column:
    """Value of a Roman numeral below 5000, blanks around it and dots after it aside; null for anything else, and for NO_NUMERALS."""
    t = F.regexp_replace(F.upper(F.trim(text)), r"\.+$", "")
    ok = ~t.isin(*NO_NUMERALS) & t.rlike("^(?=.)M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
    worth = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.when(c == "M", 1000).when(c == "D", 500).when(c == "C", 100).when(c == "L", 50).when(c == "X", 10).when(c == "V", 5).otherwise(1))
    # from the right: a letter worth less than the largest so far is taken off
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    total = F.aggregate(F.reverse(worth), start, lambda a, v: F.struct(F.when(v < a["top"], a["sum"] - v).otherwise(a["sum"] + v).alias("sum"), F.greatest(a["top"], v).alias("top")), lambda a: a["sum"])
    return F.when(ok, total)


def ordinal(n: Column) -> Column:
    last = n % 10
    suffix = F.when((n % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def congress_of(day: Column) -> Column:
    """The congress that sits on a day: terms begin on 4 March of odd years up to 1933, on 3 January from 1935. Days before the first: 1."""
    year, md = F.year(day), F.month(day) * 100 + F.dayofmonth(day)
    before = F.when(year < 1935, md < 304).otherwise(md < 103) & (year % 2 == 1)
    return F.greatest(F.lit(1), F.floor((F.when(before, year - 1).otherwise(year) - 1789) / 2).cast("int") + 1)


def safe_date(text: Column) -> Column:
    return F.substring(text, 1, 10).try_cast("date")


def natural_key(text: Column) -> Column:
    """(number, text) for natural order: 5, 5a, 42; without a number last."""
    return F.struct(F.coalesce(F.regexp_extract(text, "([0-9]+)", 1).try_cast("int"), F.lit(2147483647)).alias("n"), text.alias("t"))


def padded_page(volume: Column, page: Column, seq: Column) -> Column:
    """vvvv|prefix pppppp rest|ssssss, in which text order is citation order."""
    prefix, digits, rest = (F.regexp_extract(page, r"^([^0-9]*)([0-9]*)(.*)$", i) for i in (1, 2, 3))
    return F.concat_ws("|", F.lpad(volume.cast("string"), 4, "0"), F.concat(prefix, F.lpad(digits, 6, "0"), rest), F.lpad(seq.cast("string"), 6, "0"))


def title_score(needle: str, title: Column) -> Column:
    """0 the same, 1 its first words, 2 whole words within, 3 within, 4 not at all."""
    t, n = F.lower(title), needle.lower()
    return F.when(t == n, 0).when(t.startswith(n + " "), 1).when(F.concat(F.lit(" "), t, F.lit(" ")).contains(f" {n} "), 2).when(t.contains(n), 3).otherwise(4)


def in_ranges(n: Column, ranges: Column) -> Column:
    """n lies in one of the spans lo-hi or single numbers; what is neither is skipped."""

    def holds(r: Column) -> Column:
        lo, hi = F.get(F.split(r, "-"), F.lit(0)).try_cast("int"), F.get(F.split(r, "-"), F.lit(1)).try_cast("int")
        return F.coalesce(n.between(lo, F.coalesce(hi, lo)), F.lit(False))

    return F.exists(ranges, holds)
