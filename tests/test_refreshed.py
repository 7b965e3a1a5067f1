"""Refreshed summaries: equal to a loop over all rows, and only changed partitions are read."""

from __future__ import annotations

import duckdb
import pytest

from lawframe.operators import family, refreshed
from lawframe.operators.refreshed import Branch
from lawframe.plans import summaries

SF = "/root/testdata/sf0.001"
BRANCHES = [Branch("rows", "s", "k", {"n": ("count", "1"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}), Branch("kinds", "s", "k", distinct="v"), Branch("big", "s", "k", {"n_big": ("count", "1")}, where="v > 5")]


def put(spark, folder, rows):
    spark.createDataFrame(rows, "p string, k string, v long").write.mode("append").partitionBy("p").parquet(folder)


def looped(rows, keys):
    out = []
    for key in keys:
        v = [r[2] for r in rows if r[1] == key]
        held = [x for x in v if x is not None]
        out.append((key, len(v), sum(held) if held else None, min(held, default=None), max(held, default=None), len(set(held)), sum(x > 5 for x in held)))
    return sorted(out)


def rows_of(spark, store):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    return sorted(map(tuple, refreshed.summary(store, keys, BRANCHES).select("key", "n", "total", "low", "high", "kinds", "n_big").collect()))


def test_refresh_equals_full_build(spark, tmp_path):
    folder, store = f"{tmp_path}/s", family.Store(spark, f"file://{tmp_path}/store")
    first = [("x=1", "a", 3), ("x=1", "a", 9), ("x=1", "a", 9), ("y", "b", None), ("y", None, 4), ("z", "a", 1)]
    put(spark, folder, first)
    assert {len(v) for v in refreshed.refresh(store, {"s": folder}, BRANCHES).values()} == {3}
    assert rows_of(spark, store) == looped(first, "abc")
    number = store.current()[0]
    assert not any(refreshed.refresh(store, {"s": folder}, BRANCHES).values())
    assert store.current()[0] == number
    more = [("y", "b", 7), ("w", "a", 3), ("w", "c", 12)]
    put(spark, folder, more)
    assert set(map(tuple, refreshed.refresh(store, {"s": folder}, BRANCHES).values())) == {("p=w", "p=y")}
    assert rows_of(spark, store) == looped(first + more, "abc")
    whole = family.Store(spark, f"file://{tmp_path}/whole")
    refreshed.refresh(whole, {"s": folder}, BRANCHES)
    assert rows_of(spark, whole) == rows_of(spark, store)


def test_gone_partition_and_new_definition(spark, tmp_path):
    folder, store = f"{tmp_path}/s", family.Store(spark, f"file://{tmp_path}/store")
    put(spark, folder, [("x", "a", 3), ("y", "a", 9)])
    refreshed.refresh(store, {"s": folder}, BRANCHES)
    (tmp_path / "s" / "p=y").rename(tmp_path / "gone")
    changed = [*BRANCHES[:2], Branch("big", "s", "k", {"n_big": ("count", "1")}, where="v > 2")]
    assert [len(v) for v in refreshed.refresh(store, {"s": folder}, changed).values()] == [0, 0, 1]
    assert rows_of(spark, store)[0] == ("a", 1, 3, 3, 3, 1, 1)


def test_dies_before_it_publishes(spark, tmp_path, monkeypatch):
    folder, store = f"{tmp_path}/s", family.Store(spark, f"file://{tmp_path}/store")
    put(spark, folder, [("x", "a", 3)])
    refreshed.refresh(store, {"s": folder}, BRANCHES)
    old = rows_of(spark, store)
    put(spark, folder, [("x", "a", 8), ("y", "b", 1)])
    with monkeypatch.context() as m:
        m.setattr(family.Store, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            refreshed.refresh(store, {"s": folder}, BRANCHES)
    assert rows_of(spark, store) == old
    refreshed.refresh(store, {"s": folder}, BRANCHES)
    assert rows_of(spark, store) == looped([("x", "a", 3), ("x", "a", 8), ("y", "b", 1)], "abc")


def test_source_without_rows(spark, tmp_path):
    (tmp_path / "s").mkdir()
    store = family.Store(spark, f"file://{tmp_path}/store")
    refreshed.refresh(store, {"s": f"{tmp_path}/s"}, BRANCHES)
    assert rows_of(spark, store) == [(k, 0, None, None, None, 0, 0) for k in "abc"]


def test_query_against_sql(spark):
    got = {r["month"]: r.asDict() for r in summaries.summary_refreshed(spark, SF).collect()}
    assert len(got) == 5 and {r["n_read"] for r in got.values()} <= set(range(9))
    con = duckdb.connect()
    for b in summaries.BRANCHES:
        # the same branch over the given table, without partitions or states
        at = b.key.removeprefix("date_format(").split(",")[0]
        parts = {b.name: f"count(DISTINCT {b.distinct})"} if b.distinct else {n: f"{op}({'*' if e == '1' else e})" for n, (op, e) in b.measures.items()}
        for name, sql in parts.items():
            want = dict(con.execute(f"SELECT strftime({at}, '%Y-%m'), {sql} FROM '{SF}/{b.source}.parquet' WHERE {b.where} GROUP BY 1").fetchall())
            for m, row in got.items():
                assert row[name] == want.get(m, 0 if name in b.counts() else None), (name, m)
