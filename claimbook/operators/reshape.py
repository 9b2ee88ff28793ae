"""Long and wide shapes with column sets fixed when the plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted


def columns_matching(
    df: DataFrame, contains: Iterable[str] = (), starts_with: Iterable[str] = ()
) -> list[str]:
    """Column names holding a text or starting with one, ignoring case."""
    inner = [t.lower() for t in ([contains] if isinstance(contains, str) else contains)]
    heads = [t.lower() for t in ([starts_with] if isinstance(starts_with, str) else starts_with)]
    return [
        c
        for c in df.columns
        if any(t in c.lower() for t in inner) or any(c.lower().startswith(t) for t in heads)
    ]


def pivot_measure(
    df: DataFrame,
    id_cols: str | Sequence[str],
    name_cols: Sequence[str],
    names: Mapping[str, Sequence],
    measure: Callable[[Column], Column],
    fill: float | None = 0,
) -> DataFrame:
    """Wide table with one column per listed combination of the name columns.

    ``names`` maps each output column to the values of ``name_cols`` it stands
    for; ``measure`` receives that condition and returns the aggregate. All
    columns come from a single map-side combined aggregate on the id, one
    shuffle instead of the two of a grouped pivot.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    aggregates = []
    for name, values in names.items():
        hit = F.lit(True)
        for column, value in zip(name_cols, values, strict=True):
            hit = hit & (F.col(column) == F.lit(value))
        aggregate = measure(hit)
        if fill is not None:
            aggregate = F.coalesce(aggregate, F.lit(fill))
        aggregates.append(aggregate.alias(name))
    return df.groupBy(*ids).agg(*aggregates)


def sum_of(column: str) -> Callable[[Column], Column]:
    """Pivot measure: sum of a column."""
    return lambda hit: F.sum(F.when(hit, F.col(column)))


def row_count() -> Callable[[Column], Column]:
    """Pivot measure: number of rows."""
    return lambda hit: F.count_if(hit)


def unpivot_columns(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """Long table of all columns but the ids, values as double."""
    chosen = list(values) if values is not None else [c for c in df.columns if c not in ids]
    typed = df.select(
        *[F.col(quoted(c)) for c in ids],
        *[F.col(quoted(c)).cast("double").alias(c) for c in chosen],
    )
    return typed.unpivot(list(ids), chosen, name, value)


def unpivot_family(
    df: DataFrame,
    ids: Sequence[str],
    pattern: str,
    name: str = "name",
    value: str = "value",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Long table of the columns whose name matches a pattern.

    The first group of the pattern becomes the label; it is worked out from the
    column names when the plan is built, never per row.
    """
    candidates = columns if columns is not None else [c for c in df.columns if c not in ids]
    labels = {c: m.group(1) for c in candidates if (m := re.search(pattern, c, re.IGNORECASE))}
    if not labels:
        raise ValueError(f"no column matches {pattern!r}")
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias(name), F.col(quoted(c)).cast("double").alias(value))
            for c, label in labels.items()
        ]
    )
    return df.select(*ids, F.explode(pairs).alias("_p")).select(
        *ids, F.col(f"_p.{name}").alias(name), F.col(f"_p.{value}").alias(value)
    )
