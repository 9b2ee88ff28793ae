"""Exact quantiles of any number of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here each wanted rank is located by counting instead: first per signed
logarithmic bin of the value, then in rounds per equal-width cell between the
least and greatest value of the cell that holds the rank, until such a cell holds one
value or few rows. Each round is a map-side combined count and hands only the rows
of the wanted cells to the next; a cell is a function of the value alone, so a rerun
task repeats its result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimbook.operators.joins import join_group_values
from claimbook.sources.scratch import materialize

CELL_ROWS = 10_000
_LOG_STEPS = 64
_CELLS = 8192


def _running(cells: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    frame = (
        Window.partitionBy(*within)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return cells.withColumn("_upto", F.sum("n").over(frame))


def _inside(rank: str) -> Column:
    return (F.col(rank) > F.col("_upto") - F.col("n")) & (F.col(rank) <= F.col("_upto"))


def _holding(cells: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Cells that hold a wanted rank, the rank recounted from the cell's start."""
    before = F.col("_upto") - F.col("n")
    kept = {r: F.when(_inside(r), F.col(r) - before) for r in ranks}
    any_rank = reduce(or_, [F.col(r).isNotNull() for r in ranks])
    return cells.withColumns(kept).filter(any_rank)


def _rows_in(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that fall into one of the cells, with the cell's columns."""
    joined = join_group_values(rows, cells, keys, "n")
    return joined.filter(F.col("n_total").isNotNull())


def quantile_columns(
    df: DataFrame,
    value: str,
    named: Mapping[str, float],
    by: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Linear-interpolation quantiles, one row per group and one column per name.

    Missing values are left out; a group without values has no row. The exact
    way writes the narrow rows once and works its rounds as soon as it is called.
    ``exact=False`` uses the bounded-memory sketch in a single aggregate; it
    returns a value of the data near the quantile and does not interpolate.
    """
    by = list(by)
    v = F.col(value).cast("double")
    if not exact:
        return (
            df.filter(v.isNotNull() & ~F.isnan(v))
            .groupBy(*by)
            .agg(*[F.approx_percentile(v, p, 10000).alias(n) for n, p in named.items()])
        )
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    group = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_k0")]
    rows = materialize(
        df.select(*group, v.alias("v"))
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
        .withColumn("b0", (F.signum("v") * F.floor(F.log1p(F.abs("v")) * _LOG_STEPS)).cast("long"))
    )

    # The two neighbours of position (N - 1) * p, as 1-based ranks in the group.
    spot = {n: (F.col("n_total") - 1) * F.lit(float(p)) for n, p in named.items()}
    low = {n: f"_lo{i}" for i, n in enumerate(named)}
    high = {n: f"_hi{i}" for i, n in enumerate(named)}
    wanted = {low[n]: F.floor(s).cast("long") + 1 for n, s in spot.items()}
    wanted |= {high[n]: F.ceil(s).cast("long") + 1 for n, s in spot.items()}
    ranks = list(wanted)

    within = [*keys, "b0"]
    size = [F.count(F.lit(1)).alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max")]
    carried = [F.max(r).alias(r) for r in [*ranks, "n_total"]]
    cells = (
        rows.groupBy(*within)
        .agg(*size)
        .withColumn("n_total", F.sum("n").over(Window.partitionBy(*keys)))
        .withColumns(wanted)
    )
    cells = materialize(_holding(_running(cells, keys, "b0"), ranks).drop("_upto"))
    position = F.try_divide(F.col("v") - F.col("v_min"), F.col("v_max") - F.col("v_min"))
    while (cells.filter("v_min < v_max").agg(F.max("n")).first()[0] or 0) > CELL_ROWS:
        cell = f"b{len(within) - len(keys)}"
        inside = _rows_in(rows, cells, within).withColumn(
            cell, F.coalesce(F.floor(position * _CELLS), F.lit(0)).cast("long")
        )
        rows = materialize(inside.select(*within, cell, "v", *ranks, "n_total"))
        found = rows.groupBy(*within, cell).agg(*size, *carried)
        cells = materialize(_holding(_running(found, within, cell), ranks).drop("_upto"))
        rows, within = rows.select(*within, cell, "v"), [*within, cell]

    values = (
        _rows_in(rows, cells, within)
        .groupBy(*within, "v")
        .agg(F.count(F.lit(1)).alias("n"), *carried)
    )
    found = _running(values, within, "v")
    picked = found.groupBy(*keys).agg(
        F.max("n_total").alias("n_total"),
        *[F.max(F.when(_inside(r), F.col("v"))).alias(r) for r in ranks],
    )
    return picked.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)],
        *[
            (
                F.col(low[n])
                + (F.col(high[n]) - F.col(low[n])) * (spot[n] - F.floor(spot[n]))
            ).alias(n)
            for n in named
        ],
    )
