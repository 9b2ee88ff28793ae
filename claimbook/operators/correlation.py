"""Correlation tables and correlation-based feature removal."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted
from claimbook.operators.gram import column_means, cross_products


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlations over the rows complete in all columns; NaN for a constant."""
    rows = df.select(*[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    vectors = VectorAssembler(
        inputCols=rows.columns, outputCol="features", handleInvalid="skip"
    ).transform(rows)
    return Correlation.corr(vectors, "features").first()[0].toArray()


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long correlation matrix ``a, b, r``; ``r`` is null for a constant column."""
    matrix = correlation_matrix(df, cols)
    rows = [
        (a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long correlation matrix ``a, b, r, n``, each pair over the rows that have both values.

    Values, their squares and their masks go through one pass of cross products, from which
    every pair's own means and spreads follow. ``r`` is null where fewer than two rows have
    both, or one of the columns is constant in them. Values that are not numbers are missing.
    """
    p = len(cols)
    raw = [F.col(quoted(c)).cast("double") for c in cols]
    present = [F.when(~F.isnan(v), v) for v in raw]
    origin = column_means(df, present)
    value = [F.coalesce(v - F.lit(o), F.lit(0.0)) for v, o in zip(present, origin)]
    mask = [v.isNotNull().cast("double") for v in present]
    sums = cross_products(df, [*mask, *value, *[v * v for v in value]]).get(0, np.zeros((3 * p, 3 * p)))
    n, one, two = sums[:p, :p], sums[p : 2 * p, :p], sums[p : 2 * p, p : 2 * p]
    square = sums[2 * p :, :p]
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            m = n[i, j]
            within_a = m * square[i, j] - one[i, j] ** 2
            within_b = m * square[j, i] - one[j, i] ** 2
            between = m * two[i, j] - one[i, j] * one[j, i]
            flat = min(
                within_a - 1e-12 * m * square[i, j], within_b - 1e-12 * m * square[j, i]) <= 0
            r = None if m < 2 or flat else float(between / np.sqrt(within_a * within_b))
            rows.append((a, b, r, int(m)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, n long")


def pair_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two columns as a one-row table, null when one is constant.

    Written with the sums of both columns, so a constant column yields null
    where the built-in aggregate raises.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rows = df.select(x.alias("x"), y.alias("y")).filter("x is not null and y is not null")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return rows.agg(F.covar_pop("x", "y").alias("_c"), spread.alias("_s")).select(
        F.try_divide("_c", "_s").alias("r")
    )


def top_pairs(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs above the threshold in absolute value, strongest first, each once."""
    return corr.filter((F.col("a") < F.col("b")) & (F.abs("r") > threshold)).orderBy(
        F.abs("r").desc_nulls_last(), "a", "b"
    )


def drop_correlated(corr: DataFrame, cutoff: float = 0.6) -> list[str]:
    """Columns to remove so that no remaining pair is above the cutoff.

    Columns are visited by falling mean absolute correlation; of each pair
    still above the cutoff the column with the larger mean absolute
    correlation to the columns still present goes, and the means follow.
    ``corr`` is the long matrix, one row per column pair.
    """
    pairs = {(r["a"], r["b"]): r["r"] for r in corr.collect()}
    names = sorted({a for a, _ in pairs})
    size = {
        a: {b: abs(pairs[a, b]) for b in names if b != a and pairs.get((a, b)) is not None}
        for a in names
    }

    def mean_to(name: str, present: list[str]) -> float:
        values = [size[name][b] for b in present if b in size[name]]
        return sum(values) / len(values) if values else 0.0

    visit = sorted(names, key=lambda n: (-mean_to(n, names), n))
    present, dropped = list(visit), []
    for i, a in enumerate(visit):
        for b in visit[i + 1 :]:
            if a not in present:
                break
            if b in present and size[a].get(b, 0.0) > cutoff:
                loser = a if mean_to(a, present) > mean_to(b, present) else b
                present.remove(loser)
                dropped.append(loser)
    return dropped


def correlate_with(df: DataFrame, column: str, others: Sequence[str]) -> DataFrame:
    """Correlation of one column with several others, strongest first."""
    table = correlations(df, [column, *others])
    return (
        table.filter((F.col("a") == column) & (F.col("b") != column))
        .select(F.col("b").alias("name"), "r")
        .orderBy(F.abs("r").desc_nulls_last(), "name")
    )
