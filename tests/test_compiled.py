"""Acts in files and versions, and trees beside a unit, against small cases and brute force."""

from __future__ import annotations

import hashlib
import random

from lawframe.operators import rail, versioned

REQUEST, FILE = "prefix string, path string, through string", "prefix string, file_id long, partial_of string"
VERSION, UNIT = "version_id long, file_id long, label string, at int, content_hash string", "version_id long, path string, level string, section_num string, seq int"


def act(spark):
    files = spark.createDataFrame([("/a", 1, "X"), ("/a", 2, "9"), ("/a", 3, "Annex"), ("/b", 4, None), ("/b", 5, "I"), ("/c", 6, None), ("/a", 1, "X")], FILE)
    versions = spark.createDataFrame([(10, 1, "118-1", 5, "h10"), (11, 1, "118-2", 4, "h11"), (12, 2, "118-1", 1, "h12"), (13, 3, None, 1, "h13"), (14, 4, "118-1", 1, "h14"), (15, 5, "118-1", 1, "h15"), (16, 1, "118-1", 3, "h16")], VERSION)
    units = spark.createDataFrame([(10, "/a/t1", "title", None, 1), (10, "/a/t1/s5", "section", "5", 2), (11, "/a/t9", "title", None, 1), (12, "/a/t1", "title", None, 7), (12, "/a/s5", "section", "5", 8), (14, "/b/s1", "section", "1", 1), (15, "/b/s2", "section", "2", 1), (16, "/a/old", "title", None, 1)], UNIT)
    return files, versions, units


def ask(spark, *requests):
    return spark.createDataFrame(list(requests), REQUEST), *act(spark)


def test_resolution_rules(spark):
    asked = [
        ("/a", "", None), ("/a", "/t1/s5", None), ("/a", "/t1/s5/a/1", None), ("/a", "/t1/x", None), ("/a", "/zz/s5/q", None), ("/a", "/zz", None),
        ("/a", "/t9", None), ("/a", "/t9", "118–2"), ("/a", "/old", "118-1"), ("/a", "", "119-9"), ("/b", "/s2", None), ("/c", "", None), ("/none", "/s1", None), ("/a", "/t1/s5", None),
    ]
    got = {(r["prefix"], r["path"], r["through"]): (r["resolution"], r["served"], r["version_id"], r["provision"]) for r in versioned.resolved(*ask(spark, *asked)).collect()}
    assert len(got) == 13
    assert got["/a", "", None] == ("exact", "/a", 12, None)  # title 9 comes before title X
    assert got["/a", "/t1/s5", None] == ("exact", "/a/t1/s5", 10, None)  # by time, not by id: 10 is newer than 16 and 11
    assert got["/a", "/t1/s5/a/1", None] == ("exact", "/a/t1/s5", 10, "/a/t1/s5/a/1")
    assert got["/a", "/t1/x", None] == ("prefix", "/a/t1", 10, None)  # of two files' units the first version's
    assert got["/a", "/zz/s5/q", None] == ("section_number", "/a/t1/s5", 10, "/a/t1/s5/q")
    assert got["/a", "/zz", None] == ("prefix", "/a", 12, None)
    assert got["/a", "/t9", None][0] == "prefix" and got["/a", "/t9", "118–2"] == ("exact", "/a/t9", 11, None)
    assert got["/a", "/old", "118-1"] == ("exact", "/a/old", 16, None)  # of one label the highest id
    assert got["/a", "", "119-9"][0] == got["/c", "", None][0] == got["/none", "/s1", None][0] == "miss"
    assert got["/b", "/s2", None] == ("exact", "/b/s2", 15, None)


def test_gathered_files(spark):
    chosen = versioned.picked(*ask(spark, ("/a", "", None), ("/b", "", None), ("/a", "", "118-1"))[:3])
    got = {(r["prefix"], r["pin"]): (r["file_id"], r["n_files"], r["content_hash"]) for r in versioned.roots(chosen).collect()}
    digest = lambda *h: hashlib.sha256(":".join(h).encode()).hexdigest()
    assert got == {("/a", ""): (2, 3, digest("h12", "h10", "h13")), ("/b", ""): (4, 1, "h14"), ("/a", "=118-1"): (2, 2, digest("h12", "h16"))}
    rows = versioned.contents(chosen, act(spark)[2]).where("pin = ''").orderBy("prefix", "number", "designator", "file_id", "seq").collect()
    assert [r["path"] for r in rows] == ["/a/t1", "/a/s5", "/a/t1", "/a/t1/s5", "/b/s1"]


def test_no_rows(spark):
    empty = [spark.createDataFrame([], s) for s in (REQUEST, FILE, VERSION, UNIT)]
    assert versioned.resolved(*empty).count() == 0 and versioned.roots(versioned.picked(*empty[:3])).count() == 0
    asked = spark.createDataFrame([("/a", "/s1", None)], REQUEST)
    assert [r["resolution"] for r in versioned.resolved(asked, *empty[1:]).collect()] == ["miss"]


def forest(rnd, law, n):
    """(law, path, level, seq) in document order; some parents are left out, some sections have units below."""
    rows = []

    def grow(path, depth):
        for i in range(rnd.randrange(1, 5)):
            if len(rows) >= n:
                return
            here = f"{path}/{'s' if rnd.random() < 0.4 else 't'}{i}"
            if rnd.random() < 0.9:
                rows.append((law, here, "section" if here.split("/")[-1][0] == "s" else "title", len(rows)))
            if depth < 5:
                grow(here, depth + 1)

    while len(rows) < n:
        grow(f"{law}/v{len(rows)}", 1)
    return rows[:n]


def listed(rows, current, limit):
    """The rule by recursion over nested nodes."""
    paths = {r[1] for r in rows}
    parent = {p: next((q for q in (p.rsplit("/", i)[0] for i in range(1, p.count("/"))) if q in paths), None) for p in paths}
    children = {}
    for r in rows:
        children.setdefault(parent[r[1]], []).append(r)
    on = lambda p: current is not None and (current == p or current.startswith(p + "/"))
    out = {}

    def full(at):
        for r in children.get(at, []):
            out[r[1]] = on(r[1])
            full(r[1])

    def bounded(at):
        for r in children.get(at, []):
            out[r[1]] = on(r[1]) and r[2] != "section"
            if out[r[1]]:
                bounded(r[1])

    (full if len(rows) <= limit else bounded)(None)
    return out


def test_trees(spark):
    rnd = random.Random(3)
    laws = {f"/us/pl/{i}": forest(rnd, f"/us/pl/{i}", n) for i, n in enumerate([1, 20, 21, 60, 400])}
    units = spark.createDataFrame([r for rows in laws.values() for r in rows], "law string, path string, level string, seq int")
    nodes = rail.spans(units).checkpoint()
    for r in nodes.collect():
        under = [u for u in laws[r["law"]] if u[1].startswith(r["path"] + "/")]
        assert (r["below"], r["sections"], r["last"]) == (len(under), sum(u[2] == "section" for u in under), max([u[3] for u in under], default=r["seq"]))
        assert [u[1] for u in laws[r["law"]] if r["seq"] < u[3] <= r["last"]] == [u[1] for u in under]  # spans nest
    asked = [(law, c) for law, rows in laws.items() for c in {rnd.choice(rows)[1] for _ in range(6)} | {rows[-1][1] + "/a/1", law, None}]
    got = {}
    for r in rail.beside(nodes, spark.createDataFrame(asked, "law string, current string"), 20).collect():
        assert r["path"] not in got.setdefault((r["law"], r["current"]), {})
        got[r["law"], r["current"]][r["path"]] = r["open"]
    assert got == {(law, c): listed(laws[law], c, 20) for law, c in asked}
