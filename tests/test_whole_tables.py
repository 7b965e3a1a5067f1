"""Queries over whole tables, against brute force: ids beyond those a former version stopped at."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest

from lawframe.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """orders (key, customer, status, date) and lineitem (order, line, part, supplier, flag) as lists, and their folder."""
    rng = random.Random(5)
    orders = [(3000 + i, 60 + rng.randrange(12), rng.choice("FOP"), None if i == 7 else datetime(1992 + rng.randrange(7), 1 + rng.randrange(12), 1)) for i in range(160)]
    lines = [(o[0], n, 300 + rng.randrange(25), rng.randrange(9), rng.choice("ANR")) for o in orders for n in range(1, 2 + rng.randrange(4))]
    sf = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{sf}/lineitem.parquet")
    spark.range(1).toDF("p_partkey").write.parquet(f"{sf}/part.parquet")  # a view is made of every table whose name the text holds
    return orders, lines, sf


def rows(spark, name, sf, columns):
    return sorted(tuple(r[c] for c in columns) for r in catalogue.queries()[name](spark, sf).collect())


def test_later_amendments(spark, tables):
    orders, lines, sf = tables
    year = {o[0]: o[3] and o[3].year for o in orders}
    on = defaultdict(set)
    for order, _, part, *_ in lines:
        if year[order]:
            on[part].add((year[order], order))
    want = [(part, n) for part, at in on.items() if (n := len({b[1] for a in at for b in at if b > a}))]
    assert rows(spark, "later_amendments", sf, ["l_partkey", "later"]) == sorted(want) != []


def test_counterpart(spark, tables):
    orders, lines, sf = tables
    customer = {o[0]: o[1] for o in orders}
    pairs = Counter((a[0], b[0], a[1]) for a in lines for b in lines if a[1] == b[1] and a[0] < b[0] and customer[a[0]] == customer[b[0]])
    want = sorted((*k, n) for k, n in pairs.items())
    assert rows(spark, "counterpart", sf, ["o1", "o2", "l_linenumber", "pairs"]) == want != []


def test_budgeted_limit(spark, tables):
    orders, _, sf = tables
    want = sorted(o[0] for o in orders if o[2] == "F")[:25]
    assert rows(spark, "budgeted_limit", sf, ["o_orderkey"]) == [(k,) for k in want] and len(want) == 25


def test_snapshot_diff(spark, tables):
    orders, _, sf = tables
    want = sorted(r for o in orders if o[0] % 100 == 0 for r in (("gone", o[0], o[2]), ("new", o[0], "X")))
    assert rows(spark, "snapshot_diff", sf, ["side", "o_orderkey", "o_orderstatus"]) == want != []


def test_cited_by(spark, tables):
    _, lines, sf = tables
    edges = {(part, supplier, flag) for _, _, part, supplier, flag in lines}
    want = sorted((p, len({e[1] for e in edges if e[0] == p}), *(sum(e[0] == p and e[2] == f for e in edges) for f in "ANR")) for p in {e[0] for e in edges})
    assert rows(spark, "cited_by", sf, ["l_partkey", "sections", "a", "n", "r"]) == want != []


@pytest.mark.parametrize("query", ["later_amendments", "cited_by", "resolve_unit"])
def test_tasks_of_one_size(spark, tables, monkeypatch, query):
    """The last shuffle has more partitions for more rows, however few the session asks for."""
    from lawframe import session
    from lawframe.plans import answers, operatorsuite

    _, lines, sf = tables
    for m in (answers, operatorsuite):
        monkeypatch.setattr(m, "shares", lambda rows: session.shares(rows, 20))
    assert catalogue.queries()[query](spark, sf).rdd.getNumPartitions() == -(-len(lines) // 20) > 8


def test_parents(spark):
    from lawframe.operators import resolve

    paths = ["/a", "/a/b", "/a/b/c", "/a/x/y/z", "/q/r/s", "lone", "/a/b/", "/a//d", "/n\n/o", "/n\n"]
    want = {p: max((u for u in paths if p.startswith(u + "/")), key=len, default=None) for p in paths}
    for parts in (None, 3):
        got = resolve.parents(spark.createDataFrame([(p,) for p in [*paths, "/a/b"]], "path string"), parts).collect()
        assert {r["path"]: r["parent"] for r in got} == want and len(got) == len(paths)


def test_section_parts_are_no_lists(spark):
    """Sections' numbers come from one match of the path, not from lists of its segments, which took most of a task's time."""
    from pyspark.sql import functions as F

    from lawframe.functions import identifiers as ids

    paths = ["/us/pl/1/2/tI/s3/a/1", "s4", "/x/s5a//b//c/", "/s6/", "/us/sx/7", "/ss8/s9/s10/z", None, "", "//s1/\n", "/a\nb/s2/c\nd/"]
    segs = [[x for x in (p or "").split("/") if x] for p in paths]
    at = [next((i for i, x in enumerate(s) if x[0] == "s" and x[1:2].isdigit()), None) for s in segs]
    want = [(p, None if i is None else s[i][1:], "" if i is None else "/".join(s[i + 1 :])) for p, s, i in zip(paths, segs, at, strict=True)]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ids.section_number(F.col("p")).alias("n"), ids.below_section(F.col("p")).alias("b"))
    assert [tuple(r) for r in df.collect()] == want
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
