"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimbook.llm.tables import written

CANDIDATES = 8_192
QUERIES = 1_024
SCALE = 1_024


def usable(vector: str) -> Column:
    """True for vectors that are neither null nor hold a null or non-finite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def threshold_search(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray,
                     own: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows by (score, smaller id), best first.

    ``lists[:, d]`` orders the rows by component d, descending; it is read from its end
    where the query's component is negative, and not at all where it is zero. Each round
    doubles the depth, scores the rows seen first in it, and stops when the bound of an
    unseen row, the sum of the products at that depth, is below the k-th score.
    """
    n = len(vectors)
    used = np.flatnonzero(query)
    seen = np.zeros(n, bool)
    best = np.zeros(0, np.int64)
    scores = np.zeros(n, np.int64)
    depth, done = max(16, 4 * k), 0
    while True:
        depth = min(n, depth)
        fresh = np.zeros(n, bool)
        bound = 0
        for d in used:
            part = lists[done:depth, d] if query[d] > 0 else lists[n - depth : n - done, d]
            fresh[part] = True
            last = lists[depth - 1, d] if query[d] > 0 else lists[n - depth, d]
            bound += int(query[d]) * int(vectors[last, d])
        if not len(used):
            fresh[:] = True
        new = np.flatnonzero(fresh & ~seen)
        seen[new] = True
        scores[new] = vectors[new] @ query
        pool = np.concatenate([best, new[~own[new]]])
        if len(pool) > k:
            kth = np.partition(scores[pool], len(pool) - k)[len(pool) - k]
            pool = pool[scores[pool] >= kth]
        order = np.lexsort((ids[pool], -scores[pool]))
        best = pool[order][:k]
        if depth == n or not len(used) or seen.all() or (len(best) == k and bound < scores[best[-1]]):
            return best
        done, depth = depth, depth * 2


def _search_block(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query_copy": [], "vec_id": [], "vec_copy": [], "score": []}
        if len(left) and len(right):
            vectors = np.array(right["v"].tolist(), np.int64).reshape(len(right), -1)
            if vectors.shape[1] and float(np.abs(vectors).max()) ** 2 * vectors.shape[1] < 2.0**52:
                work = vectors.astype(np.float64)  # exact below 2**53, and faster to multiply
            else:
                work = vectors
            ids = right["rank_id"].to_numpy(np.int64)
            lists = np.argsort(-vectors, axis=0, kind="stable")
            row = right["row"].to_numpy()
            for q, mine in zip(left["v"], left.itertuples(), strict=True):
                query = np.array(q, np.int64)
                big = vectors.shape[1] and float(np.abs(query).max()) ** 2 * len(query) >= 2.0**52
                base = vectors if big else work
                at = threshold_search(base, ids, lists, query.astype(base.dtype), row == mine.row, k)
                out["query_id"] += [mine.vec_id] * len(at)
                out["query_copy"] += [mine.row] * len(at)
                out["vec_id"] += [None if right["no_id"].iat[i] else int(ids[i]) for i in at]
                out["vec_copy"] += row[at].tolist()
                out["score"] += (base[at] @ query.astype(base.dtype)).astype(np.int64).tolist()
        return pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in out.items()})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each query row, all if fewer.

    Components become floor(1024 * x); the score is their integer inner product, which must
    fit 64 bits. Candidates lie in blocks and queries in chunks of bounded size; every chunk
    meets every block once, each meeting yields at most ``k`` rows per query, and the
    best ``k`` of those are the answer. Ties go to the smaller id (null ids last).

    Vectors that are null or hold a null or non-finite component take no part. Only vectors
    of equal length are compared; empty ones score 0. A query's own row is left out;
    rows that repeat an id or a vector are candidates of each other, and a repeated query
    row is answered once per row. Null ids are never queries. Empty tables give no rows.
    """
    rows = written(vectors.filter(usable(vector)).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("size", F.size("v")))
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    blocks, chunks = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    right = rows.select(
        "size", F.pmod(F.hash("row"), F.lit(blocks)).alias("block"), each(chunks).alias("chunk"), "row", "v",
        F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("rank_id"), F.col("vec_id").isNull().alias("no_id"))
    left = rows.filter("is_query").select(
        "size", each(blocks).alias("block"), F.pmod(F.hash("row"), F.lit(chunks)).alias("chunk"), "row", "v", "vec_id")
    by = ["size", "block", "chunk"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        _search_block(k), "query_id long, query_copy long, vec_id long, vec_copy long, score long")
    best = Window.partitionBy("query_id", "query_copy").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec_copy")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
