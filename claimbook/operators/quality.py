"""Profiling and reconciliation checks; a clean table gives an empty result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimbook.functions.semantics import (
    as_column,
    descending,
    distinct_count,
    quoted,
    round_even,
    safe_div,
)
from claimbook.operators.quantiles import quantile_columns
from claimbook.operators.snapshots import keep_latest


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value) rows of the numeric columns, read in one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(quoted(c)).cast("double").alias("value"))
            for c in cols
        ]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.name", "p.value")


def summarize_columns(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """One row per column: minimum, quartiles, mean, maximum and null count."""
    long = _long(df, cols)
    basic = long.groupBy("name").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    quartiles = quantile_columns(
        long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["name"], exact
    )
    return basic.join(quartiles, "name", "left").select(
        "name", "min", "q1", "median", "mean", "q3", "max", "n_null"
    )


def summarize_dates(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """One row per date column: first, quartiles, mean and last date, and null count.

    Quantiles interpolate between days as for numbers and, like the mean, are then cut to
    whole days. Timestamps count by their day. A column without dates has nulls.
    """
    days = [F.datediff(F.col(quoted(c)).cast("date"), F.lit("1970-01-01").cast("date")).alias(f"d{i}") for i, c in enumerate(cols)]
    numbers = summarize_columns(df.select(*days), [f"d{i}" for i in range(len(cols))], exact)
    named = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (f"d{i}", c)]), F.col("name"))
    return numbers.select(
        named.alias("name"),
        *[F.date_from_unix_date(F.floor(F.round(c, 9)).cast("int")).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")],
        "n_null",
    )


def summarize_levels(df: DataFrame, cols: Sequence[str], top: int = 6) -> DataFrame:
    """The most frequent levels of text, flag or category columns with exact counts.

    Per column its ``top`` levels by rows (ties by level): ``name, place, level, n_rows, share,
    n_levels, n_null``; ``share`` is of the rows that have a value. Counts are combined before
    they are shuffled, and every task keeps the ``top`` of a column only, so a column may have
    as many levels as rows. A column without values has no row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(quoted(c)).cast("string").alias("level")) for c in cols])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("name", "level").agg(
        F.count(F.lit(1)).alias("n_rows"))
    whole = counts.groupBy("name").agg(
        F.count("level").alias("n_levels"),
        F.sum(F.when(F.col("level").isNotNull(), F.col("n_rows")).otherwise(0)).alias("n_valued"),
        F.sum(F.when(F.col("level").isNull(), F.col("n_rows")).otherwise(0)).alias("n_null"),
    )
    order = Window.partitionBy("name").orderBy(F.desc("n_rows"), "level")
    first = counts.filter(F.col("level").isNotNull()).withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= top)
    return first.join(whole, "name").select(
        "name", "place", "level", "n_rows", safe_div("n_rows", "n_valued").alias("share"), "n_levels", "n_null")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and share of every column, from one aggregate."""
    names = list(cols) if cols is not None else df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"_c{i}") for i, c in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(f"_c{i}").alias("n_null"))
            for i, c in enumerate(names)
        ]
    )
    return counts.select("_n", F.explode(rows).alias("r")).select(
        F.col("r.name").alias("name"),
        F.col("r.n_null").alias("n_null"),
        safe_div("r.n_null", "_n").alias("share_null"),
    )


def columns_with_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Names of the columns holding at least one null, in table order."""
    names = list(cols) if cols is not None else df.columns
    found = df.agg(*[F.max(F.col(quoted(c)).isNull()).alias(c) for c in names]).first()
    return [c for c in names if found[c]]


def null_patterns(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Which columns are missing together, per category, most frequent first."""
    flags = [F.col(quoted(c)).isNull().cast("int").alias(f"{c}_missing") for c in cols]
    return (
        df.select(*by, *flags)
        .groupBy(*by, *[f"{c}_missing" for c in cols])
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(*descending("n_rows"), *by, *[f"{c}_missing" for c in cols])
    )


def check_ratio(
    df: DataFrame, num: str, den: str, reported: str, digits: int = 3
) -> DataFrame:
    """Rows whose reported ratio differs from its parts after rounding."""
    gap = safe_div(num, den) - F.col(reported)
    return df.withColumn("ratio_gap", gap).filter(round_even("ratio_gap", digits) != 0)


def implied_component(df: DataFrame, parts: Sequence[str], total: str, name: str) -> DataFrame:
    """Add what is left of a total after the known parts."""
    return df.withColumn(name, F.col(total) - reduce(add, [F.col(p) for p in parts]))


def check_sum(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Rows whose parts do not add up to the total (null parts are not judged)."""
    return implied_component(df, parts, total, "sum_gap").filter("sum_gap != 0")


def check_equal(df: DataFrame, a: str, b: str, tol: float = 1.5e-8) -> DataFrame:
    """One row: largest absolute and mean relative difference of two columns.

    ``is_equal`` compares the mean relative difference with ``tol``.
    """
    gap = F.abs(F.col(a).cast("double") - F.col(b).cast("double"))
    facts = df.agg(
        F.max(gap).alias("max_abs_diff"),
        F.sum(gap).alias("_gap"),
        F.sum(F.abs(F.col(a).cast("double"))).alias("_scale"),
        F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("n_null_mismatch"),
    )
    relative = F.coalesce(safe_div("_gap", "_scale"), F.col("_gap"))
    return facts.select(
        "max_abs_diff",
        relative.alias("mean_rel_diff"),
        "n_null_mismatch",
        ((relative <= tol) & (F.col("n_null_mismatch") == 0)).alias("is_equal"),
    )


def ratio_counts(df: DataFrame, num: str, den: str, digits: int = 6) -> DataFrame:
    """How often each ratio of two columns occurs."""
    ratio = round_even(safe_div(num, den), digits).alias("ratio")
    return df.groupBy(ratio).agg(F.count(F.lit(1)).alias("n_rows"))


def check_rate(
    df: DataFrame, num: Column | str, den: Column | str, limit: float
) -> DataFrame:
    """Rows whose rate is above the limit, in no order.

    Something done in no time at all (positive over zero) has no finite rate;
    it is reported with a null rate.
    """
    numerator, denominator = as_column(num), as_column(den)
    instant = (numerator > 0) & (denominator == 0)
    rated = df.withColumn("rate", safe_div(numerator, denominator))
    return rated.filter((F.col("rate") > limit) | instant)


def check_order(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows whose later date precedes the earlier one."""
    return df.filter(F.col(later) < F.col(earlier))


def check_grain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: row count, distinct key count, and whether the keys are the grain."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    ).withColumn("is_grain", F.col("n_rows") == F.col("n_keys"))


def check_subkeys(df: DataFrame, keys: Sequence[str], sub: str) -> DataFrame:
    """Keys with more than one distinct sub-identifier."""
    return (
        df.groupBy(*keys)
        .agg(distinct_count(sub).alias("n_distinct"))
        .filter(F.col("n_distinct") > 1)
    )


def check_scope(df: DataFrame, col: str, allowed: Sequence[str], amount: str) -> DataFrame:
    """Rows of a category outside the scope that still carry an amount."""
    return df.filter(~F.col(col).isin(list(allowed)) & (F.col(amount) > 0))


def check_cap(
    df: DataFrame, col: str, cap: float, keys: Sequence[str] = (), at: str | None = None
) -> DataFrame:
    """Rows at or above a policy limit, optionally only at the latest valuation."""
    rows = keep_latest(df, keys, at) if at else df
    return rows.filter(F.col(col) >= cap)


def value_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values with their row count, in no order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def any_null(cols: Sequence[str]) -> Column:
    """True where at least one of the columns is missing."""
    return reduce(or_, [F.col(quoted(c)).isNull() for c in cols])
