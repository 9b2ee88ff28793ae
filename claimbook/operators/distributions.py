"""Share tables, histograms and box statistics: the data behind each chart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimbook.functions.semantics import safe_div
from claimbook.operators.joins import join_group_values, join_null_safe
from claimbook.operators.quantiles import quantile_columns

Limits = tuple[float | None, float | None]


def value_shares(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """Count and share of all rows per key combination, plus further aggregates.

    The grand total is a one-row scalar over the already aggregated counts.
    """
    extra = [expr.alias(name) for name, expr in (measures or {}).items()]
    table = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *extra)
    total = table.agg(F.sum("n_rows")).scalar()
    return table.withColumn("share", safe_div(F.col("n_rows"), total))


def within(df: DataFrame, col: str, limits: Limits | None) -> DataFrame:
    """Rows inside the limits, applied before any statistic; nulls are dropped."""
    if limits is None:
        return df
    low, high = limits
    kept = df
    if low is not None:
        kept = kept.filter(F.col(col) >= low)
    if high is not None:
        kept = kept.filter(F.col(col) <= high)
    return kept


def histogram(
    df: DataFrame,
    col: str,
    bins: int | None = None,
    width: float | None = None,
    by: Sequence[str] = (),
    share: str | None = None,
    limits: Limits | None = None,
    origin: float = 0.0,
    fill_empty: bool = True,
) -> DataFrame:
    """Counts per left-closed bin, the same bins for every group.

    With ``bins`` (30 unless a width is given) the range is cut into that many
    equal bins and the maximum falls into the last one; empty bins of the
    groups present are listed with count 0. With ``width`` the bins start at
    multiples of the width from ``origin`` and only bins that occur are listed.
    ``share`` is ``"all"`` (over all groups) or ``"group"``.

    With ``bins`` there are two passes: one row with range and total, then the
    counts. With ``width`` the counts are all that is needed.
    """
    if share not in (None, "all", "group"):
        raise ValueError("share is None, 'all' or 'group'")
    table, total = _binned(df, col, bins, width, by, limits, origin, fill_empty)
    whole = {"all": total, "group": F.col("n_group")}.get(share)
    if whole is not None:
        table = table.withColumn("share", safe_div(F.col("n_rows"), whole))
    return table.drop("n_group", "n_tallest")


def _binned(
    df: DataFrame,
    col: str,
    bins: int | None,
    width: float | None,
    by: Sequence[str],
    limits: Limits | None,
    origin: float,
    fill_empty: bool,
) -> tuple[DataFrame, Column]:
    """Histogram with each group's row count and tallest bin, and the grand total."""
    by = list(by)
    x = F.col(col).cast("double")
    rows = (
        within(df, col, limits)
        .select(*by, x.alias("_x"))
        .filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    )
    if width is not None:
        start, step = float(origin), float(width)
        slot = F.floor((F.col("_x") - F.lit(start)) / F.lit(step))
    else:
        bins = bins or 30
        facts = rows.agg(
            F.min("_x").alias("low"), F.max("_x").alias("high"), F.count(F.lit(1)).alias("n")
        ).first()
        start = facts["low"] if facts["n"] else 0.0
        step = (facts["high"] - facts["low"]) / float(bins) if facts["n"] else 0.0
        slot = F.floor((F.col("_x") - F.lit(start)) / F.lit(step)) if step else F.lit(0)
        slot = F.least(slot, F.lit(bins - 1))
    counts = (
        rows.withColumn("bin", slot.cast("long"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    total = F.lit(facts["n"]) if width is None else counts.agg(F.sum("n_rows")).scalar()
    first = F.lit(start)
    edges = {
        "bin_start": first + F.col("bin") * F.lit(step),
        "bin_end": first + (F.col("bin") + 1) * F.lit(step),
    }
    if width is not None or not fill_empty:
        totals = counts.groupBy(*by).agg(
            F.sum("n_rows").alias("n_group"), F.max("n_rows").alias("n_tallest")
        )
        table = join_null_safe(counts, totals, by) if by else counts.withColumns(
            {"n_group": total, "n_tallest": F.lit(None).cast("long")}
        )
        return table.withColumns(edges).select(
            *by, "bin", "bin_start", "bin_end", "n_rows", "n_group", "n_tallest"
        ), total
    # One map of at most ``bins`` counts per group, opened up again with every bin.
    packed = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n_rows"))).alias("_cells"),
        F.sum("n_rows").alias("n_group"),
        F.max("n_rows").alias("n_tallest"),
    )
    every = F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")
    table = (
        packed.filter("n_group is not null")
        .select("*", F.explode(every).alias("bin"))
        .withColumn("n_rows", F.coalesce(F.try_element_at("_cells", F.col("bin")), F.lit(0)))
    )
    return table.withColumns(edges).select(
        *by, "bin", "bin_start", "bin_end", "n_rows", "n_group", "n_tallest"
    ), total


def binned_by_category(
    df: DataFrame, category: str, value: str, bins: int = 30, limits: Limits | None = None
) -> DataFrame:
    """Histogram per category with heights scaled to each category's tallest bin."""
    table, _ = _binned(df, value, bins, None, [category], limits, 0.0, True)
    return table.withColumn("height", safe_div("n_rows", "n_tallest")).drop("n_group", "n_tallest")


def box_stats(
    df: DataFrame,
    col: str,
    by: Sequence[str],
    limits: Limits | None = None,
    exact: bool = True,
) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges and outlier count."""
    by = list(by)
    rows = (
        within(df, col, limits)
        .select(*by, F.col(col).cast("double").alias("_x"))
        .filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    )
    quartiles = quantile_columns(
        rows, "_x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, exact
    )
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    stats = join_null_safe(quartiles, sizes, by)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col("_x") >= F.col("q1") - reach) & (F.col("_x") <= F.col("q3") + reach)
    fenced = join_group_values(rows, stats, by, "n_rows")
    ends = fenced.groupBy(*by).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return ends.select(
        *by, "whisker_low", "q1", "median", "q3", "whisker_high", "n_outliers", "n_rows"
    )


def paired_bins(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Scatter data at any size: row counts on a grid of two measures."""
    x_bin = (F.floor(F.col(x) / F.lit(float(x_width))) * F.lit(float(x_width))).alias("x_start")
    y_bin = (F.floor(F.col(y) / F.lit(float(y_width))) * F.lit(float(y_width))).alias("y_start")
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(x_bin, y_bin)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
