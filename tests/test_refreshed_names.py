"""Partitions by names that are encoded in paths, and by those that are read as they stand."""

from __future__ import annotations

from lawframe.operators import refreshed
from tests.test_refreshed import BRANCHES, put


def test_names_of_partitions(spark, tmp_path):
    names = ["2024-01", "a b", "1+1", "50%", "x=y", "é"]
    put(spark, f"{tmp_path}/s", [(n, "k", i) for i, n in enumerate(names)])
    rows = spark.read.parquet(*(f"{tmp_path}/s/{p}" for p in refreshed.stamps(spark, f"{tmp_path}/s")))
    for b in BRANCHES[:2]:
        assert {r["part"] for r in refreshed.partial(rows, b).collect()} == set(refreshed.stamps(spark, f"{tmp_path}/s"))


def test_no_pattern_per_row(spark, tmp_path):
    put(spark, f"{tmp_path}/s", [("a", "k", 1)])
    plan = refreshed.partial(spark.read.parquet(f"{tmp_path}/s"), BRANCHES[0])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "contains" in plan
