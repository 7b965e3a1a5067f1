"""Written citations, composed from the grammar's parts: what names a law, and pieces that may follow it."""

from __future__ import annotations

import itertools

import pytest

from lawframe.functions.citations import parse

LAWS = {"Public Law 91-190": "/us/pl/91/190", "Pub. L. 91-190": "/us/pl/91/190", "P.L. 91–190": "/us/pl/91/190", "PL 91-190": "/us/pl/91/190", "Pub. L. No. 91-190": "/us/pl/91/190", "Private Law 83-22": "/us/pvtl/83/22", "Pvt. L. 83-22": "/us/pvtl/83/22", "91-190": "/us/pl/91/190"}
WHERE = {"": "", ", § 102": "/s102", ", section 102(2)(C)": "/s102/2/C", ", sec. 102 (2) (C)": "/s102/2/C", ", § 7A-1(b)": "/s7A-1/b", ", §§ 201-204": "/s201", ", sections 201-204": "/s201", ", secs. 5 and 6": "/s5", ", § 102 (1970)": "/s102", ", title II": "/tII", ", div. B, subtit. C, pt. 2": "/dB/stC/pt2", ", subchap. I, subpart 3": "/schI/spt3", ", title I, ch. 4, § 9": "/s9"}
REST = ["", ", 83 Stat. 852", ", Jan. 1, 1970", ", January 1, 1970, 83 Stat. 852", ", (1970)", ", as amended", ", as added by Pub. L. 94-83", "; formerly § 3", ", eff. July 1, 1970", ", 83 Stat. 852 (1970), as redesignated by Act X"]


def test_laws_with_pieces():
    for (law, base), (where, path), rest in itertools.product(LAWS.items(), WHERE.items(), REST):
        if law[0].isdigit() and (where or rest):
            continue
        kind = base.split("/")[2]
        assert parse(law + where + rest) == (kind, base + path, False), law + where + rest


def test_notes_and_leads():
    for lead, path in (("section 4(a) of ", "/s4/a"), ("Sec. 4 of the ", "/s4"), ("§ 4, title I, of ", "/s4"), ("the ", ""), ("title III of ", "/tIII")):
        assert parse(lead + "Pub. L. 92-500") == ("pl", "/us/pl/92/500" + path, False), lead
    assert parse("Pub. L. 92-500, § 4 note") == parse("Pub. L. 92-500, § 4, note") == ("pl", "/us/pl/92/500/s4", True)
    for left, right in (("(", ")"), ("[", "]"), ("“", ".”"), ('  "', '",; ')):
        assert parse(f"{left}Pub. L. 92-500{right}")[1] == "/us/pl/92/500"


def test_acts():
    for date in ("Act of June 17, 1902", "act of Jun. 17, 1902", "June 17, 1902", "1902-06-17", "The Act of June 17, 1902"):
        for chapter in (", ch. 1093", " (chapter 1093)", ", c. 1093"):
            for where, path in (("", ""), (", § 4", "/s4"), (", § 4, 32 Stat. 389", "/s4"), (", 32 Stat. 388, as amended", "")):
                assert parse(date + chapter + where) == ("act", f"/us/act/1902-06-17/ch1093{path}", False), date + chapter + where


PAGES = {"83 Stat. 852": "83/852", "83 STAT 852": "83/852", "68A Stat. 12": "68A/12", "70a Stat. 5": "70A/5", "32 Stat. A21": "32/a21", "114 Stat. 2763A-99": "114/2763a-99", "83 Stat. 852, 853": "83/852", "83 Stat. 852 (1970)": "83/852", "ch. 7, 5 Stat. 12": "5/12", "5 Stat. 12, ch. 7": "5/12"}
CODE = {"16 U.S.C. 431": "/us/usc/t16/s431", "16 USC § 431(a)(1)": "/us/usc/t16/s431/a/1", "50 U.S.C. App. 2401": "/us/usc/t50a/s2401", "16 U.S.C.": "/us/usc/t16"}


def test_pages_and_code():
    assert {t: parse(t)[1] for t in PAGES} == {t: f"/us/stat/{p}" for t, p in PAGES.items()}
    assert {t: parse(t)[1] for t in CODE} == CODE and parse("16 U.S.C. 431 note")[2]


PATHS = {"us/pl/92/500/s4/": "/us/pl/92/500/s4", "/us/pl/92/500/tI/ptB/s4/a": "/us/pl/92/500/s4/a", "/us/pl/92/500/tI": "/us/pl/92/500/tI", " /us/usc/t16/s431 ": "/us/usc/t16/s431"}


def test_paths():
    assert {t: parse(t)[1] for t in PATHS} == PATHS


@pytest.mark.parametrize("text", [None, "", " . ", "word", "Pub. L. 92", "Public Law 0-12", "92-0", "Pub. L. 92-500, and so on", "Pub. L. 92-500, § 4, § 5", "see Pub. L. 92-500", "Feb. 30, 1902, ch. 4", "June 17, 1902", "69A Stat. 3", "83 Stat.", "83 Stat. 852, § 4", "Pub. L. 92-500, 86 Stat. 816, 87 Stat. 1", "/us/xx/1/2"])
def test_rejected(text):
    assert parse(text) == (None, None, None)
