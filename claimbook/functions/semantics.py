"""Column helpers that pin down null, rounding and ordering behaviour.

Spark's ANSI mode raises on division by zero, ``least``/``greatest`` skip
nulls, ``concat`` is null as soon as one part is, and ascending sorts put nulls
first. The analyses in this package want the opposite in each case, so the
choice is made once, here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike | int | float) -> Column:
    """Column from a name, a number or a column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def safe_div(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient as double; null where the denominator is zero or null."""
    return F.try_divide(
        as_column(numerator).cast("double"), as_column(denominator).cast("double")
    )


def round_even(value: ColumnLike, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(as_column(value), digits)


def _all_present(columns: Sequence[Column]) -> Column:
    return reduce(and_, [c.isNotNull() for c in columns])


def min_of(*values: ColumnLike | int | float) -> Column:
    """Row-wise minimum that is null when any input is null."""
    columns = [as_column(v) for v in values]
    return F.when(_all_present(columns), F.least(*columns))


def max_of(*values: ColumnLike | int | float) -> Column:
    """Row-wise maximum that is null when any input is null."""
    columns = [as_column(v) for v in values]
    return F.when(_all_present(columns), F.greatest(*columns))


def finite(value: ColumnLike) -> Column:
    """NaN becomes null, so that it can never satisfy a comparison."""
    column = as_column(value)
    return F.when(~F.isnan(column), column)


def composite_key(*parts: ColumnLike, separator: str = "|", missing: str = "NA") -> Column:
    """One text key from several columns; the separator keeps keys distinct."""
    return F.concat_ws(
        separator, *[F.coalesce(as_column(p).cast("string"), F.lit(missing)) for p in parts]
    )


def pad_zero(value: ColumnLike, width: int) -> Column:
    """Left-pad with zeros; text already longer than ``width`` is left alone."""
    text = as_column(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def level_rank(label: ColumnLike, levels: Sequence[str]) -> Column:
    """1-based position of a label in an ordered level list; null off the list."""
    column = as_column(label)
    return reduce(
        lambda chain, item: chain.when(column == item[1], F.lit(item[0] + 1)),
        list(enumerate(levels))[1:],
        F.when(column == levels[0], F.lit(1)),
    )


def in_levels(value: ColumnLike, levels: Sequence) -> Column:
    """The value when it is one of the levels, else null."""
    column = as_column(value)
    return F.when(column.isin(list(levels)), column)


def distinct_count(*columns: ColumnLike, count_null: bool = False) -> Column:
    """Distinct count; with ``count_null`` a missing value counts as one more."""
    parts = [as_column(c) for c in columns]
    counted = F.count_distinct(*parts)
    if not count_null:
        return counted
    any_missing = ~_all_present(parts)
    return counted + F.coalesce(F.max(any_missing.cast("int")), F.lit(0))


def ascending(*columns: ColumnLike) -> list[Column]:
    """Ascending sort keys with missing values last."""
    return [as_column(c).asc_nulls_last() for c in columns]


def descending(*columns: ColumnLike) -> list[Column]:
    """Descending sort keys with missing values last."""
    return [as_column(c).desc_nulls_last() for c in columns]


def quoted(name: str) -> str:
    """Back-ticked column name, safe for names holding blanks or dots."""
    return "`" + name.replace("`", "``") + "`"


def free_name(base: str, taken) -> str:
    """``base``, with underscores added until no column has that name."""
    while base in taken:
        base += "_"
    return base
