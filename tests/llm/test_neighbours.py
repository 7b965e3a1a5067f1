"""Nearest neighbours where `rerank` is a small share of the rows, and where more rows tie than it holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lawframe.llm.aq import search


def table(spark, x):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<double>")


def nearest(x, query, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit[query], 12)
    sims[query] = -9
    return [int(i) for i in np.lexsort((np.arange(len(x)), -sims))[:k]]


def found(spark, x, queries):
    got = search(table(spark, x), F.col("vec_id").isin(queries)).orderBy("query_id", "rank").collect()
    return {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in queries}


def test_recall_of_many_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 64))[rng.integers(0, 200, 20_000)] + 0.7 * rng.normal(size=(20_000, 64))
    queries = list(range(0, 20_000, 200))
    got = found(spark, x, queries)
    assert sum(len(set(got[q]) & set(nearest(x, q))) for q in queries) / (5 * len(queries)) >= 0.9


@pytest.mark.parametrize("scaled", [False, True])
def test_more_ties_than_rerank(spark, scaled):
    """1500 equal vectors, or of equal direction and so equally coded: ties go to the smallest ids, for queries among them and beside them."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 24))
    same = rng.permutation(np.arange(100, 4000))[:1500]
    x[same] = x[same[0]]
    if scaled:
        x[same] *= 2.0 ** rng.integers(-8, 9, 1500)[:, None]
    x[7] = x[same[0]] + 0.05 * rng.normal(size=24)
    queries = [7, int(min(same)), int(max(same)), 50]
    got = found(spark, x, queries)
    for q in queries:
        assert got[q] == nearest(x, q)
