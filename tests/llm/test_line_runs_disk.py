"""Line runs leave no tables behind that others stand for, and none once the shared lines are known."""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

from lawframe.llm import linededup
from lawframe.llm.common import shared_dir


def folders(spark, *kinds):
    base = Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / "lawframe"
    return {p.name for p in base.iterdir() if p.name.startswith(tuple(f"lawframe_{k}_" for k in kinds)) and any(p.glob("*.parquet"))} if base.exists() else set()


def test_runs_leave_the_disk(spark):
    kinds = ("batch", "fresh", "repeats", "run0", "run1", "run2")
    before = folders(spark, *kinds)
    pairs = [(i, f"line {j}") for i in range(40) for j in range(i % 7, 30, 3)]
    table = spark.createDataFrame(pairs, "doc_id long, line string")
    runs = linededup.LineRuns(spark, 2)
    for b in range(4):
        runs.add(table.where(f"doc_id % 4 = {b}"))
    held = folders(spark, *kinds) - before
    assert len(held) <= len(runs.runs) + len(runs.repeats) + 1
    runs.clear()
    assert folders(spark, *kinds) == before
    holders = defaultdict(set)
    for i, x in pairs:
        holders[x].add(i)
    got = {r["line"]: (r["docs"], r["last_doc"]) for r in linededup.shared_lines(table, 5, 4, 2).collect()}
    assert got == {x: (len(i), max(i)) for x, i in holders.items() if len(i) >= 5} and Counter(map(len, holders.values()))
    assert folders(spark, *kinds) == before
