"""Connected components by alternating star contractions on edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimbook.llm.tables import written

MAX_ROUNDS = 100


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang neighbours on the smallest vertex next to each vertex.

    Large stars look at all edges and move the neighbours above the vertex; small stars
    look at edges towards smaller vertices and move those. The minimum is a combined
    aggregate joined back, so a vertex with very many edges is never gathered.
    """
    if both_ways:
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(lowest, "u")
    if both_ways:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def smallest_reachable(pairs: DataFrame, vertices: DataFrame, vertex: str, name: str,
                       write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``vertex, label``: the least ``name`` (nulls last) among all vertices reachable over ``pairs (a, b)``.

    Each round hands its edges to ``write``, which ends the lineage in the shared folder. The rounds
    stop when a round changes nothing; their number grows with the logarithm of the longest path.
    """
    edges = write(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u <> v").distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = state(edges)
    for _ in range(MAX_ROUNDS):
        if not now[0]:
            break
        edges = write(_stars(_stars(edges, True), False))
        after = state(edges)
        if after == now:
            break
        now = after
    else:
        raise RuntimeError("star contraction did not settle")
    named = vertices.select(F.col(vertex).alias("_vertex"), F.col(name).alias("_name"))
    root = named.join(edges, F.col("_vertex") == F.col("u"), "left").select(
        "_vertex", "_name", F.coalesce("v", "_vertex").alias("_root"))
    least = root.groupBy("_root").agg(F.min("_name").alias("label"))
    return root.join(least, "_root").select(F.col("_vertex").alias(vertex), "label")
