"""Monthly series and their classical decomposition, one or many series at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimbook.functions.semantics import safe_div
from claimbook.operators.joins import join_null_safe


def monthly(
    df: DataFrame, date: str, measures: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Aggregates per calendar month (and series)."""
    month = F.trunc(F.col(date), "month").alias("month")
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(*by, month)
        .agg(*[expr.alias(name) for name, expr in measures.items()])
    )


def month_spine(df: DataFrame, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """The same monthly series with a row for every month of each series' span."""
    spans = df.groupBy(*by).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    every = F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias(month)
    spine = spans.filter("_a is not null").select(*by, every)
    return join_null_safe(spine, df, [*by, month], "left")


def decompose(
    df: DataFrame,
    month: str,
    value: str,
    by: Sequence[str] = (),
    model: str = "multiplicative",
    period: int = 12,
) -> DataFrame:
    """Trend, seasonal figure and remainder of a monthly series.

    The trend is the centred moving average over one period (half weights at
    both ends when the period is even) and is null where the window is
    incomplete or holds a gap. The windows run over one series of months, never
    over raw rows. ``period`` divides 12: the seasonal position is the calendar
    month counted within the period.
    """
    if model not in ("multiplicative", "additive"):
        raise ValueError("model is 'multiplicative' or 'additive'")
    if 12 % period:
        raise ValueError("the period must divide the year")
    times = model == "multiplicative"
    by = list(by)
    dense = month_spine(df.select(*by, month, value), month, by).withColumn("_one", F.lit(1))
    series = by or ["_one"]

    in_order = Window.partitionBy(*series).orderBy(month)
    half = period // 2
    span = in_order.rowsBetween(-half, half)
    complete = F.count(F.col(value)).over(span) == 2 * half + 1
    summed = F.sum(F.col(value)).over(span)
    if period % 2 == 0:
        edges = F.lag(value, half).over(in_order) + F.lead(value, half).over(in_order)
        summed = summed - edges / F.lit(2.0)
    trend = F.when(complete, summed / F.lit(float(period)))
    detrended = safe_div(value, "trend") if times else F.col(value) - F.col("trend")
    with_trend = (
        dense.withColumn("trend", trend)
        .withColumn("_ratio", detrended)
        .withColumn("_position", (F.month(month) - 1) % period)
    )

    figures = with_trend.groupBy(*series, "_position").agg(F.avg("_ratio").alias("_raw"))
    centre = F.avg("_raw").over(Window.partitionBy(*series))
    figure = safe_div("_raw", centre) if times else F.col("_raw") - centre
    figures = figures.withColumn("seasonal", figure).drop("_raw")

    joined = join_null_safe(with_trend, figures, [*series, "_position"], "left")
    if times:
        remainder = safe_div(value, F.col("trend") * F.col("seasonal"))
    else:
        remainder = F.col(value) - F.col("trend") - F.col("seasonal")
    return joined.withColumn("remainder", remainder).select(
        *by, month, value, "trend", "seasonal", "remainder"
    )
