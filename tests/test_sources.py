"""Saved listings, pages and archives; repeated deliveries and windows on streams; token buckets; load steps."""

from __future__ import annotations

import datetime
import json
import zipfile

from pyspark.sql import functions as F

from lawframe.functions import identifiers as ids
from lawframe.operators import load
from lawframe.sources import listings
from lawframe.streaming import buckets, polls


def test_listing(spark, tmp_path):
    file = lambda name, folder=False: {"name": name, "folder": folder, "link": f"x/{name}", "justFileName": name, "displayLabel": name, "formattedLastModifiedTime": "02-Jan-2026 19:32", "size": 7}
    (tmp_path / "a.json").write_text(json.dumps({"files": [file("PLAW-118publ12.xml"), file("118", True), file("readme.txt"), file("PLAW-118pvtl1.zip")]}))
    (tmp_path / "bad.json").write_text("no json")
    got = sorted(tuple(r) for r in listings.listed(spark, str(tmp_path)).select("congress", "kind", "number", F.date_format("modified", "yyyy-MM-dd HH:mm")).collect())
    assert got == [(118, "publ", 12, "2026-01-02 19:32"), (118, "pvtl", 1, "2026-01-02 19:32")]
    assert [r["file"][-8:] for r in listings.whole_json(spark, str(tmp_path), listings.FILES).collect() if r["error"]] == ["bad.json"]


def test_pending(spark, tmp_path):
    bill = {"congress": 119, "number": "5", "type": "HR", "title": "T", "latestAction": {"actionDate": "2026-01-02", "text": "x"}, "laws": [{"number": "119-5", "type": "Public Law"}, {"number": "119-1", "type": "Private Law"}]}
    (tmp_path / "law.json").write_text(json.dumps({"bills": [bill, {**bill, "laws": []}]}))
    got = sorted(tuple(r) for r in listings.pending(spark, str(tmp_path)).select("law", "private", "bill_type", "action_date").collect())
    assert got == [("119-1", True, "hr", datetime.date(2026, 1, 2)), ("119-5", False, "hr", datetime.date(2026, 1, 2))]


def test_pages_overlap(spark, tmp_path):
    for offset in (0, 2):
        (tmp_path / f"entries-118-2-{offset}.json").write_text(json.dumps({"items": [{"n": offset + i} for i in range(3)], "total": 5}))
    assert sorted((r["place"], r["n"]) for r in listings.entries(spark, str(tmp_path), "n:int").collect()) == [(i, i) for i in range(5)]


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in (10, 9):
            z.writestr(f"PLAW-118publ{n}.xml", f"<pLaw>{n}</pLaw>")
        z.writestr("readme.txt", "x")
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = listings.members(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r["number"], bytes(r["content"]).decode()) for r in got if r["error"] is None] == [(9, "<pLaw>9</pLaw>"), (10, "<pLaw>10</pLaw>")]
    assert sum(r["error"] is not None for r in got) == 1


def test_stream_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 4, datetime.datetime(2026, 1, 1, 0, i)) for i in range(12)], "k int, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = polls.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "at")
    run = stream.writeStream.format("memory").queryName("once_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r["k"] for r in spark.table("once_out").collect()) == [0, 1, 2, 3]
    assert {(r["k"], r["at"].minute) for r in polls.once(rows, ["k"], "at").collect()} == {(i, i) for i in range(4)}
    assert polls.overlap_since(rows, "at") == datetime.datetime(2025, 12, 31, 0, 11)
    assert polls.overlap_since(rows.limit(0), "at") is None


def test_buckets(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(k, at + datetime.timedelta(seconds=s), i) for i, (k, s) in enumerate([(1, 0), (1, 0), (1, 0), (1, 5), (1, 30), (2, 0), (1, 31), (1, 200), (1, 200), (1, 200)])]
    got = {r["id"]: r["wait"] for r in buckets.limited(spark.createDataFrame(rows, "key long, at timestamp, id long"), 2.0, 0.1).collect()}
    tokens, last, want = {}, {}, {}
    for k, t, i in rows:
        have = min(2.0, tokens.get(k, 2.0) + (t - last.get(k, t)).total_seconds() * 0.1)
        want[i] = None if have >= 1 else max(1.0, (1 - have) / 0.1)
        tokens[k], last[k] = have - (have >= 1), t
    assert {i: w for i, w in got.items()} == want and got[2] and got[5] is None


def test_load_steps(spark, tmp_path):
    claims = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "alias string, n int")
    assert {r["n"]: r["kept"] for r in load.first_wins(claims, "alias", ["n"]).collect()} == {1: True, 2: False, 3: True}
    assert load.children_of(claims.where("n < 3").select("alias"), claims, ["alias"]).count() == 2


def test_numerals_and_terms(spark):
    cases = {"CXLVII": 147, "MIX": None, "DIV": None, "XIV.": 14, " iv ": 4, "MMMM": 4000, "IIII": None, "": None, "A": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ids.roman(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == cases
    days = {"1788-12-01": 1, "1789-03-03": 1, "1789-03-04": 1, "1791-03-03": 1, "1791-03-04": 2, "1933-03-03": 72, "1933-03-04": 73, "1935-01-02": 73, "1935-01-03": 74, "2025-01-03": 119, "2026-06-01": 119}
    got = spark.createDataFrame([(k,) for k in days], "d string").select("d", ids.congress_of(F.col("d").cast("date")).alias("n")).collect()
    assert {r["d"]: r["n"] for r in got} == days
