"""Volumes on disk: laws are not shuffled, and what is saved of them is compressed; numbers and pages go on from range to range of each file."""

from __future__ import annotations

from lawframe.plans.volumeshred import saved_volumes
from lawframe.sources import volumes


def test_no_law_is_shuffled(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<pLaw><main/></pLaw>")
    plan = volumes.units(volumes.laws(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString().split("\n")
    walked = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    assert not any("Exchange" in x or "Join" in x for x in plan[:walked])


def test_saved_small(spark, tmp_path):
    orders = spark.range(1, 2001).selectExpr("id AS o_orderkey", "date'1995-01-01' AS o_orderdate")
    lines = spark.range(8000).selectExpr("1 + id % 2000 AS l_orderkey", "CAST(1 + id % 3 AS int) AS l_linenumber", "1 + id * 7 AS l_partkey", "1 AS l_suppkey", "1 AS l_quantity", "1 AS l_extendedprice")
    saved_volumes(orders, lines, f"file://{tmp_path}/v")
    written = sum(f.stat().st_size for f in (tmp_path / "v").iterdir() if f.name.startswith("part-"))
    length = spark.read.text(f"file://{tmp_path}/v").selectExpr("sum(length(value))").first()[0]
    assert written < length / 4
    assert volumes.units(volumes.laws(spark, f"file://{tmp_path}/v")).where("level = 'section'").count() == 8000


def test_files_by_ranges(spark, tmp_path):
    """Three files in many ranges: each counts its laws and pages by itself."""
    want = []
    for f in (7, 8, 9):
        page, body = None, []
        for i in range(1, 41):
            at = f"{f}{i}" if i % 6 == f % 3 else None
            in_head = f"{f}0{i}" if i % 11 == 5 else None
            body.append((f'<page identifier="/us/stat/1/{in_head}"/>' if in_head else "") + "<pLaw><main><section><num>1</num>" + "words " * (i * f) + (f'<page identifier="/us/stat/1/{at}"/>' if at else "") + "</section></main></pLaw>")
            want.append((f"v-{f}.xml", i, in_head or page, f))
            page = at or in_head or page
        (tmp_path / f"v-{f}.xml").write_text("<r>" + "\n".join(body) + "</r>")
    for size in ("1500", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = volumes.laws(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((r["file"].rpartition("/")[2], r["law"], r["page_before"], r["volume"]) for r in got) == sorted(want, key=lambda x: x[:2])
