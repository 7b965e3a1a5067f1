"""The walk of a law's XML: few calls of Python for each element, and what the parser allows in tags and text."""

from __future__ import annotations

import sys

from lawframe.functions.units import walked

SECTION = '<section><num value="{0}">Sec.</num><heading>Part</heading><content>Words <i>of</i> <b>law</b>.<sidenote>aside</sidenote></content></section>'


def test_tags_cost_no_calls():
    """Elements without a role call nothing: a law with many more of them makes as many calls."""

    def calls(inner: str) -> int:
        xml = f"<pLaw><main>{''.join(SECTION.format(i).replace('Words', inner) for i in range(50))}</main></pLaw>"
        walked(xml)  # what its tags are is known from here on
        seen = 0

        def count(frame, event, arg):
            nonlocal seen
            seen += event == "call" and "lawframe" in frame.f_code.co_filename

        sys.setprofile(count)
        try:
            assert len(walked(xml)["units"]) == 50
        finally:
            sys.setprofile(None)
        return seen

    assert calls("Words") == calls("<p>Words <i>of</i> <b>law</b></p>" * 20)


def test_what_xml_allows():
    xml = (
        '<pLaw><main><section id="x>y"><num value=\' 4\n\'>Sec. 4.</num><content>a &amp;<!-- <section> --> b&#x41;&#66;<![CDATA[<i> & ]]>c<?go <p> ?>'
        '<page identifier="/us/stat/1/A&amp;B/"/> é</content ></section ><x:section xmlns:x="u"><x:num>5</x:num></x:section><section/></main></pLaw>'
    )
    got = walked(xml)
    assert got["error"] is None and walked(xml.encode()) == got
    assert [(u["path"], u["pages"], u["text"]) for u in got["units"]] == [("/s4", ["a&b"], "Sec. 4. a & bAB<i> & c é"), ("/s5", [], "5")]
    assert got["warnings"] == ["a section without a number after the first"]
    for broken in ("<pLaw>&nbsp;</pLaw>", "<pLaw><a></b></pLaw>", "<pLaw", "</r><r>", "<!DOCTYPE x><x/>", b"<x>\xff</x>", "<x a='<'/>", "<a b='1' b='2'/>"):
        assert walked(broken)["error"] and walked(broken)["units"] == [], broken
