"""Evaluation snapshots: first and latest valuation of each claim.

A claim may carry any share of all rows, so nothing here sorts or collects one
claim's rows in a single task. Flags come from a map-side combined minimum and
maximum joined back to the rows; totals at the latest valuation never bring raw
rows together at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimbook.operators.joins import join_group_values


def snapshot_bounds(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """First and latest valuation and the row count of each group."""
    return df.groupBy(*keys).agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("latest_at"),
        F.count(F.lit(1)).alias("n_snapshots"),
    )


def flag_snapshots(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
) -> DataFrame:
    """Add ``is_latest`` and ``is_first`` (0/1); rows tied on the date all get the flag."""
    bounds = snapshot_bounds(df, keys, at)
    joined = join_group_values(df, bounds, keys, "n_snapshots")
    return joined.withColumns(
        {
            "is_latest": F.coalesce((F.col(at) == F.col("latest_at")).cast("int"), F.lit(0)),
            "is_first": F.coalesce((F.col(at) == F.col("first_at")).cast("int"), F.lit(0)),
        }
    ).drop("first_at", "latest_at")


def keep_latest(
    df: DataFrame, keys: Sequence[str], at: str
) -> DataFrame:
    """Rows at the latest valuation of their group, ties kept."""
    flagged = flag_snapshots(df, keys, at)
    return flagged.filter("is_latest = 1").drop("is_latest", "is_first")


def keep_first(
    df: DataFrame, keys: Sequence[str], at: str
) -> DataFrame:
    """Rows at the first valuation of their group, ties kept."""
    flagged = flag_snapshots(df, keys, at)
    return flagged.filter("is_first = 1").drop("is_latest", "is_first")


def totals_at(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    measures: Mapping[str, Column],
    which: str = "latest",
) -> DataFrame:
    """Sums per group over the rows at its latest (or first) valuation.

    Two map-side combined aggregates: sums per group and date, then the sums of
    the extreme date. ``measures`` maps a name to the row expression to sum.
    """
    per_date = (
        df.filter(F.col(at).isNotNull())
        .groupBy(*keys, at)
        .agg(*[F.sum(expr).alias(name) for name, expr in measures.items()])
    )
    pick = F.max_by if which == "latest" else F.min_by
    extreme = F.max(at) if which == "latest" else F.min(at)
    # One pick per measure: flat buffers keep this a hash aggregate.
    picked = [pick(name, at).alias(name) for name in measures]
    return per_date.groupBy(*keys).agg(extreme.alias(at), *picked)
