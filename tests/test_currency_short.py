"""Keys with few rows are folded as arrays, those with many in stretches: the same as a loop, whatever the bound."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lawframe.operators import currency
from lawframe.session import written
from tests.test_currency import chance, first_of_each, fold


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(9)
    rows = [(f"k{0 if i % 3 == 0 else rnd.randrange(60)}", i, chance(rnd, rnd.randrange(25))) for i in range(600)]
    kind = f"key string, place int, c struct<{currency.FACTS.replace(' ', ':').replace(',:', ',')}>"
    return rows, written(spark.createDataFrame([(k, p, tuple(c.values())) for k, p, c in rows], kind), "made")


@pytest.mark.parametrize("few", [0, 5, 64, 10_000])
def test_newest(made, monkeypatch, few):
    rows, table = made
    monkeypatch.setattr(currency, "FEW", few)
    got = {r["key"]: (r["newest"].asDict(), r["n"]) for r in currency.newest(table, "key").collect()}
    for key in {k for k, _, _ in rows}:
        mine = first_of_each([c for k, _, c in rows if k == key])
        assert got.pop(key) == (fold(mine), len(mine))
    assert not got


def test_few_rows_pass_no_python(made):
    rows = currency._folded(F.array_sort(F.collect_list(F.struct("place", "c"))))
    plan = made[1].groupBy("key").agg(rows)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan
