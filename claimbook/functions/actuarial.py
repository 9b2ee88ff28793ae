"""Column rules of the loss, exposure and household analyses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimbook.functions.semantics import (
    ColumnLike,
    as_column,
    max_of,
    min_of,
    round_even,
    safe_div,
)

# Upper edge in months (inclusive) and label of each maturity bucket.
MATURITY_EDGES = ((3, "3m"), (6, "6m"), (9, "9m"), (12, "1y"), (24, "2y"), (36, "3y"), (48, "4y"))
MATURITY_OPEN = "4y+"
MATURITY_LEVELS = ("3m", "6m", "9m", "1y", "2y", "3y", "4y", "4y+")

# Upper edge in years (inclusive) and label of each look-back bucket.
YEARS_AGO_EDGES = ((1, "< 1 yr"), (3, "1-3 yrs"), (5, "3-5 yrs"))
YEARS_AGO_OPEN = "5+ yrs"
YEARS_AGO_LEVELS = ("< 1 yr", "1-3 yrs", "3-5 yrs", "5+ yrs")

# Insurer buckets, the first one is the model base level.
INSURER_LEVELS = ("Major_Insurer", "Minor_Insurer", "Missing")


def incurred(paid: ColumnLike, reserve: ColumnLike) -> Column:
    """Incurred loss: paid plus reserve, null when either is missing."""
    return as_column(paid) + as_column(reserve)


def layer(
    loss: ColumnLike, attachment: float, limit: float, floor_at_zero: bool = True
) -> Column:
    """Part of a loss inside the layer ``limit`` in excess of ``attachment``.

    ``floor_at_zero=False`` lets a loss below the attachment stay negative.
    """
    excess = as_column(loss) - F.lit(float(attachment))
    if floor_at_zero:
        excess = max_of(excess, 0.0)
    return min_of(excess, float(limit))


def exceeds(loss: ColumnLike, attachment: float) -> Column:
    """1 when the loss is above the attachment point, 0 when not, null if unknown."""
    return (as_column(loss) > F.lit(float(attachment))).cast("int")


def maturity(
    loss_date: ColumnLike, evaluation_date: ColumnLike, days_per_month: int = 30, digits: int = 4
) -> Column:
    """Age of a loss at its evaluation, in months of a fixed length."""
    days = F.datediff(as_column(evaluation_date), as_column(loss_date))
    return round_even(days.cast("double") / F.lit(float(days_per_month)), digits)


def _edges(value: Column, edges, open_label: str, null_to_open: bool) -> Column:
    chain = F.when(value <= edges[0][0], edges[0][1])
    for edge, label in edges[1:]:
        chain = chain.when(value <= edge, label)
    if null_to_open:
        return chain.otherwise(open_label)
    return chain.when(value.isNotNull(), open_label)


def maturity_bucket(months: ColumnLike, null_to_open: bool = False) -> Column:
    """Ordered maturity label; an unknown maturity stays null unless asked otherwise."""
    return _edges(as_column(months), MATURITY_EDGES, MATURITY_OPEN, null_to_open)


def years_ago_bucket(date: ColumnLike, as_of: dt.date) -> Column:
    """Look-back label from the difference between calendar years."""
    years = F.lit(as_of.year) - F.year(as_column(date))
    return _edges(years, YEARS_AGO_EDGES, YEARS_AGO_OPEN, null_to_open=False)


def insurer_bucket(name: ColumnLike, pattern: bool = False, null_to_major: bool = False) -> Column:
    """Group the current insurer into missing, minor and major.

    Exact upper-case match by default; ``pattern`` matches anywhere in the name
    and ignores case.
    """
    column = as_column(name)
    if pattern:
        is_missing, is_minor = column.rlike("(?i)missing"), column.rlike("(?i)other")
    else:
        is_missing, is_minor = column == "MISSING", column == "OTHER"
    major, minor, missing = INSURER_LEVELS
    chain = F.when(is_missing, missing).when(is_minor, minor)
    return chain.otherwise(major) if null_to_major else chain.when(column.isNotNull(), major)


def fault_suffix(indicator: ColumnLike) -> Column:
    """``_f`` for an at-fault claim, ``_nf`` for the rest, null when unknown."""
    column = as_column(indicator)
    return F.when(column == 1, "_f").when(column.isNotNull(), "_nf")


def minutes_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Elapsed minutes between two timestamps, as the clock of their own type counts them."""
    elapsed = (as_column(end) - as_column(start)).cast("interval second").cast("decimal(20,6)")
    return elapsed.cast("double") / F.lit(60.0)


def average_speed(miles: ColumnLike, minutes: ColumnLike, offset_minutes: float = 0.0) -> Column:
    """Miles per hour; the offset softens trips recorded as lasting zero minutes."""
    hours = (as_column(minutes) + F.lit(float(offset_minutes))) / F.lit(60.0)
    return safe_div(miles, hours)
