"""Written citations to identifiers, as a vectorised function: paths, public and private laws, acts, pages, code sections."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SCHEMA = T.StructType().add("kind", "string").add("identifier", "string").add("note", "boolean")
_SUB = r"(?P<sub>(?:\s*\((?!\d{4}\))[0-9A-Za-z]+\))*)"
_YEAR = r"(?:\s*\(\d{4}\))?"
_LAW = re.compile(r"\b(?P<kind>pub(?:lic)?|priv(?:ate)?|pvt|p)\.?\s*l(?:aw)?\.?\s*(?:no\.?\s*)?(?P<c>\d{1,3})\s*-\s*(?P<n>\d+)", re.I)
#: A section, with what may stand around its number; a plural's first one counts.
_SECTION = re.compile(r"(?P<mark>§+|sec(?:tion)?s?\.?)\s*(?P<num>\d+[A-Za-z]*(?:-\d+[A-Za-z]*)?)" + _SUB + r"(?:\s*(?:-|to|through|and)\s*\d+[A-Za-z]*(?:\([0-9A-Za-z]+\))*)*(?P<note>\s+note)?" + _YEAR, re.I)
# The volumes that have a letter.
_VOLUME = r"(?P<v>68a|70a|\d{1,3})"
_PAGE = re.compile(_VOLUME + r"\s*stat\.?\s*(?P<p>[A-Za-z]?\d+[A-Za-z]?(?:-\d+)?)" + _YEAR, re.I)
_MORE_PAGES = re.compile(r"(?:\s*,\s*\d+[A-Za-z]?)*" + _YEAR)
_CHAPTER = r"(?:ch|chapter|c)\.?\s*(?P<ch>\d+)"
_CODE = re.compile(r"^(?P<t>\d+[A-Za-z]?)\s*u\.?\s*s\.?\s*c\.?(?:ode)?\s*(?P<app>app(?:endix|\.)?)?\s*(?:§+|sec(?:tion|\.)?)?\s*(?P<num>\d+[A-Za-z0-9-]*)?" + _SUB + r"(?P<note>\s+note)?$", re.I)
_ACT = re.compile(r"^(?:the\s+)?(?:act\s+of\s+)?(?P<date>[a-z]+\.?\s+\d{1,2},\s*\d{4}|\d{4}-\d{2}-\d{2}),?\s*\(?" + _CHAPTER + r"\)?", re.I)
_ON_PAGE = re.compile(rf"^{_CHAPTER},?\s*(?=\d)", re.I)
_BARE = re.compile(r"^(?P<c>\d{1,3})\s*-\s*(?P<n>\d+)$")
#: The letters of a hierarchy level in an identifier, by the beginning of its name and what abbreviates it.
LEVELS = {"div(?:ision)?": "d", "subtit(?:le)?": "st", "title": "t", "subch(?:ap(?:ter)?)?": "sch", "ch(?:ap(?:ter)?)?": "ch", "subp(?:ar)?t": "spt", "p(?:ar)?t": "pt"}
_LEVEL = re.compile("(?:" + "|".join(f"({name})" for name in LEVELS) + r")\.?\s+(?P<num>[0-9A-Za-z]+)", re.I)
#: A date, and fixed values: pieces that say when or how a law changed and not where it is.
_WHEN = re.compile(r"\(?\b(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + r"|sept)\.?\s+\d{1,2},\s*\d{4}\)?|\(?\b\d{4}-\d{2}-\d{2}\b\)?", re.I)
_HISTORY = re.compile(r"as\s+(?:amended|added|redesignated|renumbered|revised)\b(?:\s+by\b.*)?|(?:formerly|renumbered|effective|eff)\b.*", re.I)
_PATH = re.compile(r"/us/(pl|pvtl|act|stat|sComp|usc)/\S+$")


def _date(text: str) -> str | None:
    if re.match(r"\d{4}-", text):
        parts = tuple(map(int, text.split("-")))
    else:
        word, day, year = re.match(r"([A-Za-z]+)\.?\s+(\d+),\s*(\d+)", text).groups()
        month = next((i + 1 for i, m in enumerate(MONTHS) if len(word) >= 3 and m.startswith(word.lower())), 0)
        parts = (int(year), month, int(day))
    try:
        return datetime.date(*parts).isoformat()
    except ValueError:
        return None


def _tail(rest: str) -> tuple[str, bool] | None:
    """(path below the law, note) of the pieces around a law in its citation; None if one of them says nothing that is known.

    Pieces are what commas and semicolons outside parentheses part. A section stands for its levels; without one the
    levels make the path. One section and one page may be given; dates, years and the law's history say nothing.
    """
    section, note, page, levels = None, False, False, []
    for piece in re.split(r"[,;](?![^()]*\))", _WHEN.sub(" ", rest)):
        piece = piece.strip(" .:")
        if not piece or re.fullmatch(r"\(\d{4}\)", piece) or _HISTORY.fullmatch(piece):
            continue
        if section is None and (m := _SECTION.fullmatch(piece)):
            plural = m["mark"].startswith("§§") or m["mark"].lower().rstrip(".").endswith("s")
            section = f"/s{m['num'].split('-')[0] if plural else m['num']}" + _below(m["sub"])
            note = note or bool(m["note"])
        elif m := _LEVEL.fullmatch(piece):
            levels.append("/" + list(LEVELS.values())[next(i for i, g in enumerate(m.groups()) if g)] + m["num"])
        elif not page and _PAGE.fullmatch(piece):
            page = True
        elif piece.lower() == "note":
            note = True
        else:
            return None
    return section or "".join(levels), note


def _below(sub: str | None) -> str:
    return "".join("/" + x for x in re.findall(r"\(([0-9A-Za-z]+)\)", sub or ""))


def _unwrapped(text: str) -> str:
    """Without quotes, brackets and stops around it, and without a pair of parentheses around all of it."""
    while True:
        out = text.strip(" .,;\"'[]“”‘’")
        if out[:1] == "(" and out[-1:] == ")" and "(" not in out[1:-1] and ")" not in out[1:-1]:
            out = out[1:-1]
        if out == text:
            return out
        text = out


def _path(text: str) -> str | None:
    """A path as it is kept: with its root's slash, without levels above a section."""
    t = "/" + text.strip("/ ")
    if not _PATH.match(t):
        return None
    parts = t.split("/")
    at = next((i for i, x in enumerate(parts) if i > 4 and re.match(r"s[0-9]", x)), None)
    if parts[2] in ("pl", "pvtl", "act") and at:
        parts = parts[:5] + parts[at:]
    return "/".join(parts)


def parse(text: str | None) -> tuple[str | None, str | None, bool | None]:
    """(kind, identifier, note) of a written citation; kind is the identifier's root; all None for what is none."""
    none = (None, None, None)
    t = re.sub("[\u2010-\u2015]", "-", re.sub(r"\s+", " ", text or ""))
    t = _unwrapped(t)
    if not t:
        return none
    if re.match("/?us/", t):
        path = _path(t)
        return (path.split("/")[2], path, False) if path else none
    if m := _CODE.match(t):
        title = m["t"].lower() + ("a" if m["app"] else "")
        return ("usc", f"/us/usc/t{title}" + (f"/s{m['num']}{_below(m['sub'])}" if m["num"] else ""), bool(m["note"]))
    if (m := _LAW.search(t) or _BARE.match(t)) is not None:
        kind = "pvtl" if (m.groupdict().get("kind") or "p").lower() in ("priv", "private", "pvt") else "pl"
        before = re.fullmatch(r"(?:(?P<what>.*?),?\s*\bof\s+)?(?:the\s+)?", t[: m.start()], re.I)
        tail = _tail(f"{before['what'] or ''},{t[m.end() :]}") if before else None
        return (kind, f"/us/{kind}/{int(m['c'])}/{int(m['n'])}{tail[0]}", tail[1]) if tail and int(m["c"]) and int(m["n"]) else none
    if m := _ACT.match(t):
        day, tail = _date(m["date"]), _tail(t[m.end() :])
        return ("act", f"/us/act/{day}/ch{int(m['ch'])}{tail[0]}", tail[1]) if day and tail else none
    # a chapter on a page is cited by the page
    t = re.sub(rf",\s*{_CHAPTER}$", "", _ON_PAGE.sub("", t), flags=re.I)
    if (m := _PAGE.match(t)) and (more := _MORE_PAGES.match(t, m.end())) and _tail(t[more.end() :]) == ("", False):
        return ("stat", f"/us/stat/{m['v'].upper()}/{m['p'].lower()}", False)
    return none


@F.pandas_udf(SCHEMA)
def cite_parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in texts], columns=["kind", "identifier", "note"])


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, each part edited once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
