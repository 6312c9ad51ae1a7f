"""Exact top-k inner products by pivot-table elimination.

Whole-number vectors; largest inner product means smallest distance once norms are known, since
2 q.x = |q|^2 + |x|^2 - d(q, x)^2. The distances of every vector to a fixed set of pivots are computed
first. For a query the largest |d(q, p) - d(x, p)| bounds d(q, x) from below and so the product from
above. Candidates are evaluated in the order of that bound until it falls below the k-th best product.

Candidates are dealt into chunks of about ``CHUNK`` rows and meet the queries in blocks of ``BLOCK``
rows; every (chunk, block) pair is one group of bounded size, and sends k rows per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

PIVOTS = 32
PIVOT_SAMPLE = 2_000
CHUNK = 20_000
BLOCK = 2_048
BATCH = 256


def whole_vectors(df: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * component); vectors that are null, empty of numbers or hold a
    null or non-finite component are left out."""
    x = F.col("v")
    out = df.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return out.filter(fine & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots from a sample of vectors."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def search_chunk(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (score descending, id ascending) of the chunk for each query, its own row left out."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    table, from_pivots = distances(vectors, pivots), distances(queries, pivots)
    norm, query_norm = (vectors**2).sum(1), (queries**2).sum(1)
    out = []
    for i, query in enumerate(queries):
        least = np.abs(table - from_pivots[i]).max(1) if pivots.size else np.zeros(len(ids))
        slack = 1e-6 * (query_norm[i] + norm) + 1  # rounding of the square roots never hides a candidate
        bound = (query_norm[i] + norm - least**2) / 2 + slack
        by = np.argsort(-bound, kind="stable")
        best_score, best_id = np.zeros(0), np.zeros(0, np.int64)
        for a in range(0, len(by), BATCH):
            if len(best_score) == k and bound[by[a]] < best_score[-1]:
                break
            take = by[a : a + BATCH]
            take = take[ids[take] != query_ids[i]]
            score = np.concatenate([best_score, vectors[take] @ query])
            who = np.concatenate([best_id, ids[take]])
            top = np.lexsort((who, -score))[:k]
            best_score, best_id = score[top], who[top]
        out += [(int(query_ids[i]), int(v), int(s)) for v, s in zip(best_id, best_score)]
    return out


def top_k(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``.

    Scores are whole numbers computed without rounding while they stay below 2^53. A query meets the vectors
    of its own length; lengths the sample of the pivots lacks are searched without bounds. Rows that repeat an
    id are candidates each; of queries with one id the shortest and least vector is asked, and a query
    never meets rows of its own id. An empty table gives no rows. Other columns are ignored.
    """
    vectors = whole_vectors(df).withColumn("width", F.size("v"))
    sample = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()
    schema = "query_id long, vec_id long, score long"
    if not sample:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = {n: choose_pivots(np.array([r.v for r in sample if len(r.v) == n], float)) for n in {len(r.v) for r in sample}}
    chosen = F.col("vec_id") % every == 0
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if(chosen).alias("q")).first()
    chunks, blocks = -(-sizes.n // CHUNK), max(1, -(-sizes.q // BLOCK))
    block_list, chunk_list = F.array(*map(F.lit, range(blocks))), F.array(*map(F.lit, range(max(1, chunks))))
    candidates = vectors.select("vec_id", "v", "width", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, chunks))).cast("int").alias("chunk"), F.explode(block_list).alias("block"))
    asked = vectors.filter(chosen).groupBy("vec_id").agg(F.min(F.struct("width", "v")).alias("q"))
    queries = asked.select("vec_id", "q.v", "q.width", F.explode(chunk_list).alias("chunk"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        own = pivots.get(int(left.width.iloc[0]), np.zeros((0, int(left.width.iloc[0]))))
        rows = search_chunk(np.array(right.v.tolist(), float), right.vec_id.to_numpy(), np.array(left.v.tolist(), float), left.vec_id.to_numpy(), own, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = candidates.groupBy("chunk", "block", "width").cogroup(queries.groupBy("chunk", "block", "width")).applyInPandas(work, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
