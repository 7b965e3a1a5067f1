"""Keyed state: the stream with restarts against the batch and against a loop; out of order, swept and waiting requests."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from lawframe.plans import streams
from lawframe.streaming import buckets, keyed

SF = "/root/testdata/sf0.001"
SCHEMA = "key long, at timestamp, id long"
T0 = datetime(2024, 3, 1)


def looped(rows, capacity, per_second):
    out, held = [], {}
    for key, at, ident in sorted(rows):
        tokens, last = held.get(key, (capacity, at))
        tokens, wait = buckets.settle(tokens, (at - last).total_seconds(), capacity, per_second)
        held[key] = (tokens, at)
        out.append((key, at, ident, wait))
    return sorted(out, key=repr)


def run(spark, tmp_path, deliveries, capacity, per_second, delay="100 seconds"):
    for rows in deliveries:
        keyed.drop(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        keyed.drained(keyed.limited(stream, capacity, per_second, delay), f"{tmp_path}/out", f"{tmp_path}/state")
    return sorted(map(tuple, spark.read.schema(f"{SCHEMA}, wait double").parquet(f"{tmp_path}/out").collect()), key=repr)


def test_restarts_and_disorder_match_a_loop(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    first = [(1, at(50), 5), (1, at(10), 1), (1, at(10), 0), (1, at(10), 0), (2, at(0), 7), (1, at(90), 9)]
    second = [(1, at(60), 6), (2, at(61), 8), (1, at(5000), 10), (1, at(5001), 11), (1, at(5001), 12), (3, at(86_400 * 2), 13)]
    closing = [(0, at(86_400 * 9), None)]
    got = run(spark, tmp_path, [first, second, closing], 2.0, 0.01)
    assert got == looped(first + second, 2.0, 0.01)
    assert any(w is not None for *_, w in got)


def test_only_what_the_watermark_passed(spark, tmp_path):
    rows = [(1, T0, 1), (1, T0 + timedelta(seconds=500), 2)]
    assert [r[2] for r in run(spark, tmp_path, [rows], 1.0, 0.1)] == [1]


def test_rows_that_are_no_requests(spark, tmp_path):
    rows = [(None, T0, 1), (1, None, 2), (1, T0, None), (1, T0, 3)]
    assert [r[2] for r in run(spark, tmp_path, [rows, [(9, T0 + timedelta(days=1), None)]], 1.0, 0.1)] == [3]


def test_walk_ends_with_an_empty_run():
    left = [4, 2, 0, 9]
    assert keyed.walked(lambda: left.pop(0), 10) == [4, 2, 0]
    assert keyed.walked(lambda: 1, 3) == [1, 1, 1]


@pytest.fixture(scope="module")
def answered(spark):
    return sorted(map(tuple, streams.rate_limit_stream(spark, SF).collect()), key=repr)


def test_query_equals_a_loop(spark, answered):
    rows = [(r["key"], r["at"], r["id"]) for r in streams.requests(spark, SF).collect()]
    assert answered == looped(rows, streams.CAPACITY, streams.PER_SECOND)
