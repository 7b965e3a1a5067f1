"""Joins on any of several equalities: each pair once, whatever repeats, and frequent values dealt to many tasks."""

from __future__ import annotations

import pytest

from lawframe.operators import resolve

LEFT = [(1, 1, 5), (1, 1, 6), (1, 2, 5), (2, None, 7), (None, 9, 7), (3, 2, None), (3, 2, 5), (4, 8, 8)]
RIGHT = [(10, 1, 5), (10, 2, 6), (11, 2, 5), (11, 2, 7), (None, 9, 7), (12, None, None), (13, 8, 8)]


@pytest.mark.parametrize("pairs", [1, 4_000_000])
def test_each_pair_once(spark, monkeypatch, pairs):
    monkeypatch.setattr(resolve, "PAIRS", pairs)
    a, b = spark.createDataFrame(LEFT, "x int, a int, b int"), spark.createDataFrame(RIGHT, "y int, c int, d int")
    want = {(x, y) for x, p, q in LEFT for y, c, d in RIGHT if (p is not None and p == c) or (q is not None and q == d)}
    got = resolve.any_of(a, b, [(a["a"], b["c"]), (a["b"], b["d"])], ["x", "y"])
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_pairs_are_not_shuffled(spark):
    a, b = spark.range(100).selectExpr("id AS x", "id % 3 AS a"), spark.range(100).selectExpr("id AS y", "id % 3 AS c")
    got = resolve.any_of(a, b, [(a["x"], b["y"]), (a["a"], b["c"])], ["x", "y"])
    top = got._jdf.queryExecution().optimizedPlan().nodeName()
    assert top == "Union" and got.count() == got.distinct().count() == 34 * 34 + 2 * 33 * 33
