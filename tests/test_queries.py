"""Every named query of the package against DuckDB, and the entry."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from lawframe.plans import catalogue

SF = driver.SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_without_oracle(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 7
