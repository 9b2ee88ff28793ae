"""Joins whose behaviour stays safe with nulls, hot keys and growing lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimbook.functions.semantics import free_name, quoted

# The largest groups, this many less one, are attached where their rows are. Every other group
# has at most 1 / HOT_PARTS of all rows, however large the data is.
HOT_PARTS = 64


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal key names where a missing key matches a missing key."""
    side = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys])
    return left.join(side, condition, how).drop(*["_r_" + k for k in keys])


def join_group_values(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str
) -> DataFrame:
    """Attach one row per group back to the rows of that group, in one read of the rows.

    ``groups`` holds the keys, the group's row count in ``size`` and the values
    to attach; rows of no group get nulls. The largest groups, fewer than
    ``HOT_PARTS``, are broadcast. A row that finds its group among them takes the
    values and draws a salt from its own content, so the join of all other rows
    by key, in which it finds nothing more, moves it to any task. A missing key
    matches a missing key.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("join_group_values needs at least one key")
    values = [c for c in groups.columns if c not in keys and c != size]
    drawn = free_name("_salt", rows.columns)

    def named(prefix: str) -> DataFrame:
        return groups.withColumnsRenamed({c: prefix + c for c in (*keys, *values, size)})

    def match(prefix: str) -> Column:
        return reduce(and_, [F.col(quoted(k)).eqNullSafe(F.col(quoted(prefix + k))) for k in keys])

    largest = named("_h_").orderBy(F.desc("_h_" + size), *["_h_" + k for k in keys]).limit(HOT_PARTS - 1)
    found = F.col("_h_" + size).isNotNull()
    content = [F.col(quoted(c)) for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    salt = F.when(found, 1 + F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.lit(1 << 20))).otherwise(0)
    # A group's salt is zero for any count; written so that it stays a column to join on.
    others = named("_g_").withColumn("_g__salt", F.when(F.col("_g_" + size) < 0, 1).otherwise(0).cast("bigint"))
    joined = (
        rows.join(F.broadcast(largest), match("_h_"), "left")
        .withColumn(drawn, salt.cast("bigint"))
        .join(others, match("_g_") & (F.col(drawn) == F.col("_g__salt")), "left")
    )
    return joined.select(
        *[F.col(quoted(c)) for c in rows.columns],
        *[F.when(found, F.col(quoted("_h_" + v))).otherwise(F.col(quoted("_g_" + v))).alias(v) for v in values],
    )


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str = "left",
) -> DataFrame:
    """Join a reference table by key; Spark broadcasts it where its size allows."""
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in _keys(on)}
    side = lookup.withColumnsRenamed({r: "_r_" + r for r in pairs.values()})
    condition = reduce(and_, [F.col(a) == F.col("_r_" + b) for a, b in pairs.items()])
    return df.join(side, condition, how).drop(*["_r_" + b for b in pairs.values()])


def join_keyed(
    left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "left"
) -> DataFrame:
    """Equi-join on differently named keys; the right-hand keys are dropped."""
    side = right.withColumnsRenamed({r: "_r_" + r for r in on.values()})
    condition = reduce(and_, [F.col(a) == F.col("_r_" + b) for a, b in on.items()])
    return left.join(side, condition, how).drop(*["_r_" + b for b in on.values()])


def join_fill(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    fill: float = 0,
    how: str = "left",
) -> DataFrame:
    """Left join that fills the joined numeric columns of rows that matched nothing.

    A missing value of a matched row stays missing.
    """
    keys = _keys(key)
    numeric = [c for c, t in right.dtypes if c not in keys and not t.startswith(("string", "date", "timestamp", "bool", "array", "map", "struct", "binary"))]
    joined = left.join(right.withColumn("_matched", F.lit(True)), keys, how)
    filled = {c: F.when(F.col("_matched").isNull(), F.lit(fill)).otherwise(F.col(quoted(c))) for c in numeric}
    types = dict(right.dtypes)
    return joined.withColumns({c: e.cast(types[c]) for c, e in filled.items()}).drop("_matched")


def duplicate_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The table itself, after checking that its keys are unique and not null."""
    names = _keys(keys)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in names])
    broken = (
        df.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter((F.col("n_rows") > 1) | missing)
        .limit(1)
        .count()
    )
    if broken:
        raise ValueError(f"keys {names} are not a unique, complete key of the right-hand table")
    return df
