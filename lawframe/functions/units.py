"""One law's XML in one pass: its units with numbers, ancestors, pages and text, and what names the law.

The parser only checks the text, without calling Python. `Walk` then goes over its tags, which one pattern has cut out, in
a single loop, as a call for each tag and text would take most of the time; what a tag without attributes is, is looked up
once. A stack holds what is open; no tree is built. Numbers stand in a child that comes first, so a level gets its
identifier when a level below it opens, or when it closes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from xml.parsers import expat

# Letters of the levels in an identifier, levels below a section (which have none), subtrees that hold no
# units, elements whose text is not the law's, and elements after which a blank stands.
LETTERS = {"division": "d", "title": "t", "subtitle": "st", "chapter": "ch", "subchapter": "sch", "part": "pt", "subpart": "spt", "section": "s"}
BELOW = {"subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem", "subsubitem"}
NO_UNITS = {"quotedContent", "toc", "sidenote", "footnote", "note"}
APPARATUS = {"sidenote", "page", "footnote", "toc", "editorialNote"}
BLOCKS = {"p", "section", "subsection", "paragraph", "subparagraph", "clause", "content", "chapeau", "heading", "num", "title", "chapter", "part", "continuation"}
META = {"type", "docNumber", "congress", "publicPrivate", "approvedDate"}

UNIT = "struct<seq:int,level:string,num:string,heading:string,path:string,occurrence:int,parent:string,ancestors:array<struct<path:string,level:string,num:string,heading:string>>,depth:int,first_page:string,pages:array<string>,text:string,content_hash:string>"
LAW = f"doc_type string, doc_number string, congress string, public_private string, approved string, note string, hrefs array<string>, preface string, quoted int, warnings array<string>, last_page string, units array<{UNIT}>, error string"
_WORD = re.compile(r"[^\s.—–:()\[\],;]+")


#: A tag, comment, CDATA section or instruction of XML that the parser has passed, and what is in a tag.
_TAG = re.compile(r"""(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?:[^>"'!?]++|"[^"]*"|'[^']*'|[!?])*+>)""", re.DOTALL)
_NAME = re.compile(r"</?([^\s/>]+)")
_ATTRIBUTE = re.compile(r"""([^\s=<"']+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile("&(#x?)?([^;]+);")
_MARKS = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
OPENS, CLOSES, EMPTY = 1, 2, 3
#: Elements that do something besides having text; all others only stand between their tags.
LEVELS = LETTERS.keys() | BELOW
ROLES = LEVELS | NO_UNITS | APPARATUS | META | {"main", "num", "heading", "preface", "ref"}
_kinds: dict[str, tuple[int, str, bool]] = {}


@dataclass(slots=True, eq=False)
class Open:
    """An open level. path: once it is known, below the law; addressed: None until the number has been looked for."""

    name: str
    start: int
    num: str | None = None
    said: list[str] = field(default_factory=list)
    heading: list[str] = field(default_factory=list)
    path: str | None = None
    addressed: bool | None = None
    unit: dict | None = None
    text: list[str] = field(default_factory=list)


def resolved(text: str) -> str:
    """Text with its references put in."""
    return _REFERENCE.sub(lambda m: _MARKS[m[2]] if not m[1] else chr(int(m[2], 16 if m[1] == "#x" else 10)), text)


def attributes(tag: str) -> dict[str, str]:
    """A tag's attributes, with blanks for other white space in them."""
    plain = "&" not in tag and tag.isprintable()
    return {k: x or y if plain else resolved(re.sub(r"\r\n|[\t\r\n]", " ", x or y)) for k, x, y in _ATTRIBUTE.findall(tag)}


def kind(tag: str) -> tuple[int, str, bool]:
    """(what it does, name without prefix, whether the name has a role) of a tag; (0, "", False) of anything else."""
    if tag[1] in "!?":
        return 0, "", False
    name = _NAME.match(tag)[1].rpartition(":")[2]
    out = CLOSES if tag[1] == "/" else EMPTY if tag[-2] == "/" else OPENS, name, name in ROLES
    if "=" not in tag and len(_kinds) < 10_000:
        _kinds[tag] = out
    return out


def one_line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def number_of(level: str, value: str | None, text: str) -> str | None:
    """The number of a level: the value given, else the first word of its text that isn't the level's name or a section mark."""
    if value and value.strip():
        return value.strip()
    names = {level.lower(), "sec", "section", "§"}
    return next((w for w in _WORD.findall(text) if w.lower() not in names), None)


class Walk:
    def __init__(self, xml: str):
        self.xml, self.units, self.warnings = xml, [], []
        self.seen: dict[str, int] = {}
        self.meta: dict[str, list[str]] = {}
        self.note: list[str] = []
        self.preface: list[str] = []
        self.hrefs: list[str] = []
        self.page: str | None = None
        self.quoted = 0
        self.section_seen = False
        self.approved: str | None = None
        self.levels: list[Open] = []  # open ones

    def run(self) -> None:
        # a record has lost its file's root; names with a prefix need no declaration here
        expat.ParserCreate().Parse(f"<r>{self.xml}</r>", True)
        stack: list[tuple] = []  # (name, level or None, what text went to outside)
        parts: tuple[list[str], ...] = ()  # what text goes to just now, besides that of sections
        sections: list[list[str]] = []  # texts of open sections that are units
        hidden = silent = at = 0
        main = False
        levels, pieces = self.levels, _TAG.split(self.xml)
        for i in range(1, len(pieces), 2):
            said, tag = pieces[i - 1], pieces[i]
            if said:
                at += len(said)
                if "&" in said:
                    said = resolved(said)
                if not silent:
                    for text in sections:
                        text.append(said)
                for part in parts:
                    part.append(said)
            start, at = at, at + len(tag)
            what, name, role = _kinds.get(tag) or kind(tag)
            if not what:
                if tag.startswith("<![CDATA["):
                    for part in parts if silent else (*sections, *parts):
                        part.append(tag[9:-3])
                continue
            if what != CLOSES:
                if not role:
                    stack.append((name, None, parts))
                else:
                    outer, above, level = parts, stack[-1] if stack else ("", None, ()), None
                    if name == "page":
                        self.turn(attributes(tag).get("identifier", ""))
                    elif name == "main":
                        main = True
                    elif main and name in LEVELS:
                        if hidden:
                            self.quoted += name == "section"
                        else:
                            level = self.open_level(name, start)
                            if name == "section":
                                sections.append(level.text)
                    elif name == "num" or name == "heading":
                        if above[1] is not None:
                            if name == "heading":
                                parts = (*parts, above[1].heading)
                            else:
                                parts = (*parts, above[1].said)
                                if above[1].addressed is None and "=" in tag:
                                    above[1].num = attributes(tag).get("value") or above[1].num
                    elif name == "ref":
                        if (to := attributes(tag).get("href")) and {"sidenote", "longTitle"} <= {e[0] for e in stack}:
                            self.hrefs.append(to.strip())
                    elif name == "approvedDate":
                        self.approved = self.approved or attributes(tag).get("date") or None
                    if name in META and any(e[0] == "meta" for e in stack):
                        parts = (*parts, self.meta.setdefault(name, []))
                    elif name == "sidenote":
                        parts = (self.note,) if any(e[0] == "longTitle" for e in stack) else ()
                    elif name == "preface":
                        parts = (self.preface,)
                    elif name in APPARATUS and not (name == "toc" and above[0] == "num"):
                        parts = tuple(p for p in parts if p is self.note)
                    hidden += name in NO_UNITS
                    silent += name in APPARATUS
                    stack.append((name, level, outer))
            if what != OPENS:
                _, level, parts = stack.pop()
                if role:
                    hidden -= name in NO_UNITS
                    silent -= name in APPARATUS
                    if level is not None:
                        if level.addressed is None:
                            self.address(level, len(levels) - 1)
                        levels.pop()
                        if level.name == "section":
                            sections.pop()
                            level.unit["hash"] = hashlib.sha256(self.xml[level.start : at].encode()).hexdigest()
                if sections and not silent and name in BLOCKS:
                    for text in sections:
                        text.append(" ")

    def turn(self, identifier: str) -> None:
        """A page begins."""
        label = identifier.rstrip("/").rpartition("/")[2].lower()
        if label:
            self.page = label
            for e in self.levels:
                if e.unit is not None:
                    e.unit["pages"].append(label)

    def open_level(self, name: str, start: int) -> Open:
        for place, e in enumerate(self.levels):
            if e.addressed is None:
                self.address(e, place)
        here = Open(name, start)
        if name in LETTERS:
            chain = [e for e in self.levels if e.path and e.name in LETTERS and e.name != "section"]
            here.unit = {"first_page": self.page, "pages": [], "chain": chain}
            self.units.append(here)
        self.levels.append(here)
        return here

    def address(self, e: Open, place: int) -> None:
        """Looks for the number of the open level at that place and sets the path, or leaves the level without one."""
        value = number_of(e.name, e.num, "".join(e.said))
        e.addressed = True
        if e.name == "section":
            if value is None and not self.section_seen:
                value = "1"
            elif value is None:
                self.warnings.append("a section without a number after the first")
            self.section_seen = True
        e.num = value
        if value is None:
            e.addressed = False
            return
        above = ""
        for x in reversed(self.levels[:place]):
            if x.path:
                above = x.path
                break
        e.path = f"{above}/{LETTERS.get(e.name, '')}{value}"
        n = self.seen[e.path] = self.seen.get(e.path, 0) + 1
        if e.unit is not None:
            e.unit["occurrence"] = n
            if n > 1 and e.name == "section":
                self.warnings.append(f"{e.path} occurs {n} times")

    def law(self) -> dict:
        said = {k: one_line(v) or None for k, v in self.meta.items()}
        kept = [e for e in self.units if e.path]
        units = []
        for seq, e in enumerate(kept, 1):
            chain = [{"path": x.path, "level": x.name, "num": x.num, "heading": one_line(x.heading) or None} for x in e.unit["chain"]]
            body = one_line(e.text) if e.name == "section" else None
            units.append({"seq": seq, "level": e.name, "num": e.num, "heading": one_line(e.heading) or None, "path": e.path, "occurrence": e.unit["occurrence"], "parent": chain[-1]["path"] if chain else None, "ancestors": chain, "depth": len(chain) + 1, "first_page": e.unit["first_page"], "pages": e.unit["pages"], "text": body, "content_hash": e.unit.get("hash")})
        return {"doc_type": said.get("type"), "doc_number": said.get("docNumber"), "congress": said.get("congress"), "public_private": said.get("publicPrivate"), "approved": said.get("approvedDate") or self.approved, "note": one_line(self.note), "hrefs": self.hrefs, "preface": one_line(self.preface), "quoted": self.quoted, "warnings": self.warnings, "last_page": self.page, "units": units, "error": None}


def walked(xml: str | bytes | None) -> dict:
    """The law as a row of LAW; of XML that can't be read only `error`."""
    walk = Walk(xml.decode(errors="surrogateescape") if isinstance(xml, bytes) else xml or "")
    try:
        walk.run()
    except (expat.ExpatError, UnicodeEncodeError) as e:
        empty = dict.fromkeys(["doc_type", "doc_number", "congress", "public_private", "approved", "note", "preface", "last_page"])
        return empty | {"hrefs": [], "quoted": 0, "warnings": [], "units": [], "error": f"{e}"}
    return walk.law()
