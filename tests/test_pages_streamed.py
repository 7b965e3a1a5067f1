"""Pages are saved from entries that come one after the other, so that a task holds one page and not a batch of them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lawframe.plans.paging import saved_pages


def test_pages_are_not_gathered(spark, tmp_path, monkeypatch):
    placed = spark.range(330).select(F.lit(1).alias("congress"), (F.col("id") % 3).cast("int").alias("session"), (F.col("id") / 3).cast("int").alias("place"), F.to_json(F.struct("id")).alias("item"))
    plans = []
    for name in ("mapInPandas", "mapInArrow"):
        real = getattr(type(placed), name)
        monkeypatch.setattr(type(placed), name, lambda self, *a, real=real, **b: (plans.append(self._jdf.queryExecution().executedPlan().toString()), real(self, *a, **b))[1])
    saved_pages(placed, f"file://{tmp_path}/p", 20)
    assert len(plans) == 1 and "collect_list" not in plans[0]
    got = {f.name: [x["id"] for x in json.loads(f.read_text())["items"]] for f in (tmp_path / "p").glob("entries-*.json")}
    assert got == {f"entries-1-{s}-{at}.json": [3 * i + s for i in range(at, min(at + 22, 110))] for s in range(3) for at in range(0, 110, 20)}
