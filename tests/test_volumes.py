"""Volumes read in many ranges; units, pages and identity of their laws."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lawframe.functions.identity import doc_number, identity
from lawframe.functions.units import number_of, walked
from lawframe.sources import volumes

HEAD = '<?xml version="1.0"?><statutesAtLarge xmlns="urn:x" xmlns:dc="urn:dc"><meta><volume>61</volume></meta><main><collection>'
META = "<meta><dc:type>{kind}</dc:type><docNumber>{n}</docNumber><congress>80</congress><publicPrivate>{side}</publicPrivate><approvedDate>1947-0{m}-11</approvedDate></meta>"


def law(i, body, kind="Public Law", n=None, side="public", preface="", title=""):
    return f"<component><pLaw>{META.format(kind=kind, n=i if n is None else n, side=side, m=i % 9 + 1)}<preface>{preface}</preface><main><longTitle>{title}</longTitle>{body}</main></pLaw></component>"


def page(n):
    return f'<page identifier="/us/stat/61/{n}">[61 STAT. {n}]</page>'


BODY = (
    f'<title><num value="I">TITLE I—</num><heading>Of <b>canals</b><footnote>1</footnote></heading>{page("12A")}'
    '<section><num value="1">Sec. 1.</num><heading>Name</heading><content>This Act.<sidenote>Short title.</sidenote></content></section>'
    '<section><num>Sec. 2.</num><chapeau>Add:</chapeau><subsection><num value="a">(a)</num><content>one'
    f'<quotedContent><section><num value="9">Sec. 9.</num><content>Quoted words.</content></section></quotedContent></content></subsection>{page(13)}<subsection><num>(b)</num><content>two &amp; more</content></subsection></section></title>'
    '<title><num>TITLE II</num><part><num value="A"/><section><num value="1">Sec. 1.</num><content>again</content></section><section><num value="1">Sec. 1.</num><content>twice</content></section><section><content>no number</content></section></part></title>'
)


def test_walk():
    got = walked(law(3, BODY).removeprefix("<component>").removesuffix("</component>"))
    assert got["error"] is None and got["quoted"] == 1 and got["last_page"] == "13"
    assert got["warnings"] == ["/tII/ptA/s1 occurs 2 times", "a section without a number after the first"]
    assert (got["doc_type"], got["doc_number"], got["congress"], got["approved"]) == ("Public Law", "3", "80", "1947-04-11")
    rows = [(u["seq"], u["level"], u["path"], u["occurrence"], u["parent"], u["depth"], u["first_page"], u["pages"], u["text"]) for u in got["units"]]
    assert rows == [
        (1, "title", "/tI", 1, None, 1, None, ["12a", "13"], None),
        (2, "section", "/tI/s1", 1, "/tI", 2, "12a", [], "Sec. 1. Name This Act."),
        (3, "section", "/tI/s2", 1, "/tI", 2, "12a", ["13"], "Sec. 2. Add: (a) oneSec. 9. Quoted words. (b) two & more"),
        (4, "title", "/tII", 1, None, 1, "13", [], None),
        (5, "part", "/tII/ptA", 1, "/tII", 2, "13", [], None),
        (6, "section", "/tII/ptA/s1", 1, "/tII/ptA", 3, "13", [], "Sec. 1. again"),
        (7, "section", "/tII/ptA/s1", 2, "/tII/ptA", 3, "13", [], "Sec. 1. twice"),
    ]
    assert got["units"][0]["heading"] == "Of canals" and [a["num"] for a in got["units"][5]["ancestors"]] == ["II", "A"]
    assert len({u["content_hash"] for u in got["units"] if u["level"] == "section"}) == 4


def test_walk_edges():
    first = walked("<pLaw><main><section><content>That</content></section><section><num>2</num></section></main></pLaw>")
    assert [u["path"] for u in first["units"]] == ["/s1", "/s2"]
    assert walked("<pLaw><main><section></main></pLaw>")["error"] and walked("")["units"] == [] and walked(None)["error"] is None
    deep = "<paragraph><num value='1'/>" * 3000 + "</paragraph>" * 3000
    assert walked(f"<pLaw><main><section><num value='1'/>{deep}</section></main></pLaw>")["units"][0]["path"] == "/s1"
    assert [number_of("title", None, t) for t in ("TITLE IV—", "§ 12.", "[3]", "—", "")] == ["IV", "12", "3", None, None] and number_of("section", " 4a ", "x") == "4a"


@pytest.fixture(scope="module")
def volume(tmp_path_factory):
    at = tmp_path_factory.mktemp("volumes") / "STATUTE-99.xml"
    bodies = [law(i, (page(20 + i) if i % 3 == 0 else "") + f'<section><num value="1">Sec. 1.</num><content>{"é word " * (i * 20)}</content></section>' + (BODY if i % 7 == 0 else ""), preface=page(f"{i}a") if i % 5 == 0 else "") for i in range(1, 60)]
    bodies[30] = "<component><pLaw><main><section>broken</main></pLaw></component>"
    bodies.insert(10, "<component><resolution><main>Not a law</main></resolution></component>")
    at.write_text(HEAD + "\n".join(bodies) + "</collection></main></statutesAtLarge>")
    return at


def read(spark, at, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", str(size))
    try:
        d = volumes.laws(spark, str(at))
        rows = sorted((r["law"], r["volume"], r["page_before"], r["error"] is None, r["is"]["primary"], len(r["units"])) for r in d.collect())
        found = sorted((r["law"], r["seq"], r["identifier"], r["occurrence"], r["first_page"], tuple(r["pages"]), r["text"] or "", r["content_hash"] or "") for r in volumes.units(d).collect())
        return rows, found, volumes.records(spark, str(at)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranges_give_the_same(spark, volume):
    one, many = read(spark, volume, 1 << 30), read(spark, volume, volume.stat().st_size // 40)
    assert one[:2] == many[:2] and one[2] == 1 and many[2] > 8
    rows, found, _ = one
    assert [r[0] for r in rows] == list(range(1, 60)) and {r[1] for r in rows} == {61}
    assert [r[0] for r in rows if not r[3]] == [31]
    page_ = None  # the cursor, law by law
    for i in range(1, 60):
        assert rows[i - 1][2] == page_
        if i == 31:
            continue
        page_ = f"{i}a" if i % 5 == 0 else page_
        page_ = str(20 + i) if i % 3 == 0 else page_
        first = next(f for f in found if f[0] == i)
        assert (first[2], first[4]) == (f"/us/pl/80/{i}/s1", page_)
        page_ = "13" if i % 7 == 0 else page_


CASES = {
    ("Public Law", "12", 80, None, "1947-01-02", "", (), ""): ("typed", "pl", "/us/pl/80/12", ()),
    ("Private Law", "[7]", 80, None, "1947-01-02", "", (), "CHAPTER 40 and"): ("typed", "pvtl", "/us/pvtl/80/7", ("/us/act/1947-01-02/ch40",)),
    ("Chapter", "XLI", 80, "public", "1947-01-02", "[H. R. 5] [Public Law 1,012]", (), ""): ("note", "pl", "/us/pl/80/1012", ("/us/act/1947-01-02/ch41",)),
    ("Chapter", "41", 80, "private", "1947-01-02", "Public Lavv, No. 5", (), ""): ("note", "pvtl", "/us/pvtl/80/5", ("/us/act/1947-01-02/ch41",)),
    ("Chapter", "41", 80, None, "1947-01-02", "", ("/us/stat/1/2", "/us/bill/80/pl/77"), ""): ("link", "pl", "/us/pl/80/77", ("/us/act/1947-01-02/ch41",)),
    ("Act", "9", 80, "private", None, "", (), ""): ("flag", "pvtl", "/us/pvtl/80/9", ()),
    ("Chapter", "9", 40, "public", "1868-02-03", "Public Law 3", (), ""): ("chapter", "act", "/us/act/1868-02-03/ch9", ()),
    ("Chapter", "9", 80, None, None, "", (), ""): (None, None, None, ()),
    (None, None, None, None, None, None, (), None): (None, None, None, ()),
}


def test_identity(spark):
    rows = [(i, *k[:4], None if k[4] is None else datetime.date.fromisoformat(k[4]), k[5], list(k[6]), k[7]) for i, k in enumerate(CASES)]
    d = spark.createDataFrame(rows, "i int, t string, n string, c int, s string, e date, note string, h array<string>, p string")
    got = {r["i"]: r["x"] for r in d.select("i", identity(*(F.col(c) for c in ("t", "n", "c", "s", "e", "note", "h", "p"))).alias("x")).collect()}
    for i, (rule, kind, primary, more) in enumerate(CASES.values()):
        assert (got[i]["rule"], got[i]["kind"], got[i]["primary"], tuple(got[i]["aliases"])) == (rule, kind, primary, ((primary,) if primary else ()) + more)
    assert "a number before numbers began" in got[6]["warnings"] and got[8]["warnings"] == ["nothing names the law"] and "the note's kind is not the record's" in got[3]["warnings"]
    cases = {"3": 3, "[3]": 3, "CXLVII": 147, " 12. ": 12, "q": None, "": None}
    assert {r["t"]: r["n"] for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", doc_number(F.col("t")).alias("n")).collect()} == cases
