"""Ordered shredding of XML and HTML: table functions with a row per element or link, and visible text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# Subtrees whose elements are no units, and elements that end a block of text.
SKIPPED = {"quotedContent", "toc", "sidenote", "footnote", "note"}
BLOCKS = {"p", "section", "subsection", "paragraph", "content", "chapeau", "heading", "num", "title", "chapter"}
LEVELS = {"division", "title", "subtitle", "chapter", "subchapter", "part", "subpart", "section"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "head", "template", "noscript"}


def _name(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def reading_text(element: ET.Element) -> str:
    """Text without notes and the like, a blank after blocks, white space as one blank."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        if _name(e.tag) not in SKIPPED:
            out.append(e.text or "")
            for child in e:
                walk(child)
                out.append(child.tail or "")
            if _name(e.tag) in BLOCKS:
                out.append(" ")

    walk(element)
    return " ".join("".join(out).split())


def shred(xml: str | None) -> list[tuple]:
    """(pos, depth, tag, identifier, parent_pos, num, heading, skipped, page, text) of each element in document order."""
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        root = None
    rows: list[tuple] = []

    def walk(e: ET.Element, depth: int, parent: int | None, skipped: bool) -> None:
        tag, pos = _name(e.tag), len(rows)
        skipped = skipped or tag in SKIPPED
        child = {_name(c.tag): c for c in reversed(list(e))}
        num, heading = child.get("num"), child.get("heading")
        page = (e.get("identifier") or "").rpartition("/")[2].lower() or None if tag == "page" else None
        rows.append((pos, depth, tag, e.get("identifier"), parent, (num.get("value") or reading_text(num)) if num is not None else None, reading_text(heading) if heading is not None else None, skipped, page, reading_text(e) if tag in LEVELS else None))
        for c in e:
            if isinstance(c.tag, str):
                walk(c, depth + 1, pos, skipped)

    if root is not None:
        walk(root, 0, None, False)
    return rows


@udtf(returnType="pos int, depth int, tag string, identifier string, parent_pos int, num string, heading string, skipped boolean, page string, text string")
class ShredXml:
    def eval(self, xml: str):
        yield from shred(xml)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.links = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.links.append((len(self.links), dict(attrs)["href"], self.stack[-1] if self.stack else None))
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if not HIDDEN.intersection(self.stack):
            self.text.append(data)


def read_page(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


@udtf(returnType="pos int, href string, container string")
class Links:
    def eval(self, html: str):
        yield from read_page(html).links


@F.pandas_udf(T.StringType())
def visible_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: " ".join(" ".join(read_page(h).text).split()))
