"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as a sum of M codewords, one of each of M full-dimensional codebooks. Training, on at most
`sample` vectors: k-means on the residuals, codebook after codebook, then beam-search codes and least squares for all
codewords at once, `refits` times. Encoding of every row keeps the `beam` best partial sums from codebook to codebook.
The index holds a row's codes and the norm of its reconstruction. A query's inner products with all codewords make a lookup
table; a candidate's score is the sum of M entries over its stored norm. The `rerank` best of a query, and all that tie with
the last of them, are scored exactly on the original vectors, in double precision.

Equal vectors are searched as one, by their smallest vec_id, and the best found are given back their smallest ids.

Queries are dealt in blocks against chunks of the index; what leaves a block and chunk is `rerank` + 1 rows per query (the
query's own vector may be one of them), and the ties of the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>): rows that are not null, not zero and hold finite numbers only, of the commonest length."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL AND size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.coalesce(fine, F.lit(False))).where(F.exists("embedding", lambda x: x != 0))
    length = v.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1)
    return v.join(F.broadcast(length.select("n")), F.size("embedding") == F.col("n")).drop("n")  # one row


class Codebooks:
    def __init__(self, books: np.ndarray):
        self.books = books  # M x K x D

    @classmethod
    def fit(cls, x: np.ndarray, m: int = 24, k: int = 64, beam: int = 4, iterations: int = 6, refits: int = 1, seed: int = 7) -> Codebooks:
        rng = np.random.default_rng(seed)
        k = min(k, len(x))
        residual, books = x.copy(), []
        for _ in range(m):
            centres = residual[rng.choice(len(x), k, replace=False)]
            for _ in range(iterations):
                near = np.argmin((centres**2).sum(1) - 2 * residual @ centres.T, axis=1)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, residual)
                counts = np.bincount(near, minlength=k)
                centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
            books.append(centres)
            residual = residual - centres[np.argmin((centres**2).sum(1) - 2 * residual @ centres.T, axis=1)]
        self = cls(np.stack(books))
        for _ in range(refits):
            codes, _ = self.encode(x, beam)
            chosen = np.zeros((len(x), m * k), np.float32)
            np.put_along_axis(chosen, codes + np.arange(m) * k, 1, axis=1)
            gram, right = (chosen.T @ chosen).astype(np.float64), chosen.T.astype(np.float64) @ x
            solved = np.linalg.solve(gram + 1e-3 * np.eye(m * k), right + 1e-3 * self.books.reshape(m * k, -1))
            self.books = solved.reshape(m, k, -1)
        return self

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x M, uint8) and norms of the reconstructions, by beam search over the codebooks."""
        n, (m, k, d) = len(x), self.books.shape
        sums, codes = np.zeros((n, 1, d)), np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            b = sums.shape[1]
            residual = x[:, None, :] - sums
            # |r - c|^2, a row per vector with its beam x K continuations
            cost = ((residual**2).sum(2)[:, :, None] - 2 * (residual.reshape(-1, d) @ book.T).reshape(n, b, k) + (book**2).sum(1)).reshape(n, b * k)
            width = min(beam, b * k)
            best = np.argpartition(cost, width - 1, axis=1)[:, :width]
            row = np.arange(n)[:, None]
            sums = sums[row, best // k] + book[best % k]
            codes = np.concatenate([codes[row, best // k], (best % k).astype(np.uint8)[:, :, None]], axis=2)
        pick = np.argmin(((x[:, None, :] - sums) ** 2).sum(2), axis=1)
        row = np.arange(n)
        return codes[row, pick], np.linalg.norm(sums[row, pick], axis=1)


def _unit(lists) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in lists])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def train(vectors: DataFrame, sample: int = 10_000, **options) -> Codebooks | None:
    """Codebooks of a bounded sample: the `sample` rows first in the order of a hash of vec_id. None without rows."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    return Codebooks.fit(_unit([r[0] for r in rows]), **options) if rows else None


def index(vectors: DataFrame, model: Codebooks, beam: int = 4) -> DataFrame:
    """(vec_id, codes binary, norm) of every row, a written table."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 2048):
                part = b.iloc[start : start + 2048]
                codes, norms = model.encode(_unit(part["embedding"]), beam)
                yield pd.DataFrame({"vec_id": part["vec_id"], "codes": [c.tobytes() for c in codes], "norm": norms})

    return written(vectors.mapInPandas(code, "vec_id long, codes binary, norm double"), "aq-index")


def nearby(queries: DataFrame, coded: DataFrame, model: Codebooks, rerank: int = 500, block: int = 1024, chunk: int = 65536) -> DataFrame:
    """(query_id, vec_id): for each query (query_id, embedding) the `rerank` + 1 rows with the best lookup-table scores, and the ties of the last."""
    most = rerank + 1
    blocks = max(1, -(-queries.count() // block))
    chunks = max(1, -(-coded.count() // chunk))
    q = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    x = coded.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    books = model.books

    def score(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "near": []}).astype({"query_id": "int64", "vec_id": "int64", "near": "float64"})
        m = books.shape[0]
        codes = np.frombuffer(b"".join(xs["codes"]), np.uint8).reshape(-1, m).T.copy()
        norms, ids = np.maximum(xs["norm"].to_numpy(), 1e-9), xs["vec_id"].to_numpy()
        out = []
        tables = np.einsum("qd,mkd->qmk", _unit(qs["embedding"]), books)
        for qid, table in zip(qs["query_id"].to_numpy(), tables, strict=True):
            near = table[0][codes[0]]
            for i in range(1, m):
                near = near + table[i][codes[i]]
            near = near / norms
            top = np.flatnonzero(near >= np.partition(near, -most)[-most]) if len(near) > most else np.arange(len(near))
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[top], "near": near[top]}))
        return pd.concat(out)

    found = q.groupBy("b", "c").cogroup(x.groupBy("b", "c")).applyInPandas(score, "query_id long, vec_id long, near double")
    if chunks == 1:
        return found.select("query_id", "vec_id")
    best = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("near")))
    return found.withColumn("r", best).where(F.col("r") <= most).select("query_id", "vec_id")


def grouped(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, embedding, lead): of each set of equal vectors the rows of its k smallest ids; lead is the smallest."""
    same = Window.partitionBy("embedding")
    d = vectors.withColumn("r", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("r") <= k)
    return d.withColumn("lead", F.min("vec_id").over(same)).drop("r")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = 10_000, rerank: int = 500) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query row found, by cosine, ties to the smaller vec_id.

    Rows that `usable` leaves out take no part. No rows: no result. vec_id is unique; of repeated rows each counts.
    """
    spark = vectors.sparkSession
    v = written(usable(vectors), "vectors")
    members = written(grouped(v, k + 1), "aq-members")  # k others, should the query be one of them
    leads = members.where("vec_id = lead").dropDuplicates(["vec_id"])
    model = train(leads, sample)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = v.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearby(queries, index(leads, model), model, rerank)
    # cosines don't change with a power of two, and the squares of scaled vectors neither overflow nor vanish
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("embedding", F.abs)))))
    scaled = lambda d: d.withColumn("scale", scale).withColumn("embedding", F.transform("embedding", lambda x: x / F.col("scale"))).drop("scale")
    normed = lambda d: scaled(d).withColumn("norm", F.sqrt(_dot(F.col("embedding"), F.col("embedding"))))
    pairs = found.join(normed(leads.select("vec_id", "embedding")), "vec_id").join(normed(queries).select("query_id", F.col("embedding").alias("q"), F.col("norm").alias("qn")), "query_id")
    scored = pairs.select("query_id", F.col("vec_id").alias("lead"), (_dot(F.col("embedding"), F.col("q")) / (F.col("norm") * F.col("qn"))).alias("score"))
    best = lambda at: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), at))
    sets = scored.withColumn("r", best("lead")).where(F.col("r") <= k + 1).drop("r")  # each holds a row, so no further set can hold one of the k
    rows = sets.join(members.select("lead", "vec_id"), "lead").where("vec_id <> query_id")
    return rows.withColumn("rank", best("vec_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
