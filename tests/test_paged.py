"""The paged source: batches and streams over saved and served pages, with pages that overlap, fail and are missing."""

from __future__ import annotations

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lawframe.operators import load
from lawframe.sources.paged import PagedSource, chain, ranges

ITEMS = "id string, n int, tags string"


def item(i, c=118):
    return {"id": f"{c}-{i}", "n": str(i) if i % 2 else i, "tags": ["x", i], "more": None}


def save(folder, totals, pages):
    folder.mkdir(exist_ok=True)
    (folder / "tables.json").write_text(json.dumps({"tables": [{"congress": c, "session": s, "total": n} for (c, s), n in totals.items()]}))
    for (c, s, at), items in pages.items():
        (folder / f"entries-{c}-{s}-{at}.json").write_text(items if isinstance(items, str) else json.dumps({"items": items}))


@pytest.fixture
def paged(spark):
    spark.dataSource.register(PagedSource)
    return lambda root, **options: spark.read.format("paged").options(root=str(root), items=ITEMS, page="3", **options).load()


def places(df):
    return sorted((r["congress"], r["place"], r["n"]) for r in df.collect() if r["error"] is None)


def test_batch(paged, tmp_path):
    full = [item(i) for i in range(10)]
    # the first page has more than was asked for, the second is short, and a page that no range begins with follows it
    save(tmp_path / "p", {(118, 1): 10, (119, 2): 2, (120, 1): 0}, {(118, 1, 0): full[:5], (118, 1, 3): full[3:5], (118, 1, 5): full[5:6], (118, 1, 6): full[6:9], (118, 1, 9): full[9:], (119, 2, 0): [item(0, 119), item(1, 119)]})
    for pages in ("1", "2", "10"):
        df = paged(tmp_path / "p", pages=pages)
        assert df.columns == ["congress", "session", "place", "total", "error", "id", "n", "tags"]
        assert places(df) == [(118, i, i) for i in range(10)] + [(119, 0, 0), (119, 1, 1)] and df.where("error IS NOT NULL").count() == 0
        assert df.rdd.getNumPartitions() == {"1": 5, "2": 3, "10": 2}[pages]
    assert df.where("congress = 118 AND place = 1").first()["tags"] == '["x", 1]'


def test_missing_and_broken(paged, tmp_path):
    save(tmp_path / "p", {(1, 1): 6, (2, 1): 4, (3, 1): 2, (4, 1): 1}, {(1, 1, 0): [item(i) for i in range(3)], (2, 1, 0): [item(i) for i in range(2)], (2, 1, 2): [], (3, 1, 0): "{no json", (4, 1, 0): ["text"]})
    got = paged(tmp_path / "p").collect()
    assert sorted((r["congress"], r["place"], r["error"].split(":")[0]) for r in got if r["error"]) == [(1, 3, "page at 3 is missing"), (2, 2, "page at 2 is empty"), (3, 0, "page at 0 is no JSON"), (4, 0, "no object")]
    assert sum(r["error"] is None for r in got) == 5
    assert paged(tmp_path / "nothing").count() == 0


def test_ranges():
    got = ranges({(1, 1): 25, (1, 2): 0}, 3, 4, {(1, 1): 2})
    assert [(r.start, r.stop) for r in got] == [(2, 14), (14, 25)]


def test_served(paged):
    """Each page fails twice before it is served; marks name the next page."""
    failed: dict[str, int] = {}

    class Serve(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            at = urllib.parse.urlparse(self.path)
            query = dict(urllib.parse.parse_qsl(at.query))
            failed[self.path] = failed.get(self.path, 0) + 1
            if failed[self.path] < 3:
                self.send_response(429 if failed[self.path] == 1 else 503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if at.path == "/tables":
                answer = {"tables": [{"congress": 118, "session": 1, "total": 7}]}
            elif at.path == "/entries":
                first = int(query["offset"])
                answer = {"items": [item(i) for i in range(first, min(7, first + int(query["limit"])))]}
            else:
                k = 0 if query["mark"] == "*" else int(query["mark"])
                answer = {"items": [item(k)], "next": str(k + 1) if k < 4 else None}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        assert places(paged(root, wait="0.01")) == [(118, i, i) for i in range(7)]
        assert sorted(r["n"] for r in paged(root, walk="mark", wait="0.01").collect()) == list(range(5))
    finally:
        server.shutdown()


def run(spark, root, out, at, **options):
    """One run of a stream until nothing is new, each batch upserted by id into a table of generations."""

    def put(batch, n):
        fresh = batch.select("id", "n", "place")
        try:
            stored = load.promoted(spark, out)
        except Exception:  # noqa: BLE001
            stored = fresh.limit(0)
        load.promote(load.upsert(stored, fresh, "id", "n", "place").drop("outcome"), out)

    stream = spark.readStream.format("paged").options(root=str(root), items=ITEMS, page="3", **options).load()
    query = stream.where("error IS NULL").writeStream.foreachBatch(put).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sum(p["numInputRows"] for p in query.recentProgress), sorted(r["n"] for r in load.promoted(spark, out).collect())


def test_stream_of_offsets_restarts(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    root, out, at = tmp_path / "p", str(tmp_path / "out"), str(tmp_path / "at")
    all_ = [item(i) for i in range(9)]
    save(root, {(118, 1): 4}, {(118, 1, 0): all_[:3], (118, 1, 3): all_[3:4]})
    assert run(spark, root, out, at) == (4, [0, 1, 2, 3])
    save(root, {(118, 1): 9}, {(118, 1, 4): all_[4:8], (118, 1, 7): all_[7:], (118, 1, 8): all_[8:]})
    assert run(spark, root, out, at) == (5, list(range(9)))  # goes on where the checkpoint ends
    assert run(spark, root, out, str(tmp_path / "another")) == (9, list(range(9)))  # all again: the same table


def test_stream_of_marks_restarts(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    root, out, at = tmp_path / "p", str(tmp_path / "out"), str(tmp_path / "at")
    root.mkdir()
    put = lambda mark, n, following: (root / f"marks-{mark}.json").write_text(json.dumps({"items": [item(n), item(n + 1)], "next": following}))
    put("%2A", 0, "b")
    put("b", 2, "c")
    put("c", 4, None)
    assert run(spark, root, out, at, walk="mark")[1] == [0, 1, 2, 3]
    put("c", 4, "d")
    put("d", 5, None)  # repeats an item of the page before
    assert run(spark, root, out, at, walk="mark") == (2, [0, 1, 2, 3, 4, 5])


def test_chain_ends():
    class Two:
        def marked(self, mark):
            return {"*": {"next": "a"}, "a": {"next": None}}.get(mark)

    assert [p.mark for p in chain(Two(), "*", last=True)[0]] == ["*", "a"] and [p.mark for p in chain(Two(), "*")[0]] == ["*"] and chain(Two(), "*")[1] == "a" and chain(Two(), "x") == ([], "x")


def test_long_pages_of_saved_folders(spark, tmp_path):
    """Each page goes on into the next, and no page begins where one ends: the next multiple's page has the rest."""
    from pyspark.sql import functions as F

    from lawframe.plans.paging import saved_pages

    spark.dataSource.register(PagedSource)
    placed = spark.range(95).select(F.lit(1).alias("congress"), F.lit(2).alias("session"), F.col("id").cast("int").alias("place"), F.to_json(F.struct("id")).alias("item"))
    root = f"file://{tmp_path}/long"
    saved_pages(placed, root, 20)
    got = spark.read.format("paged").options(root=root, items="id long", page="20", pages="2").load().collect()
    assert sorted((r["place"], r["id"], r["total"], r["error"]) for r in got) == [(i, i, 95, None) for i in range(95)]
