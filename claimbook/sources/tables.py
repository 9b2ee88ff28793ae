"""Reading and writing tables with declared types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimbook.functions.semantics import quoted
from claimbook.sources.schemas import DATE_PATTERN


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    fmt: str | None = None,
    date_pattern: str = DATE_PATTERN,
) -> DataFrame:
    """Scan delimited text (header row) or parquet.

    Delimited text needs a schema: columns are matched by header name, and a
    cell that does not parse as its declared type is null.
    """
    paths = [path] if isinstance(path, str) else list(path)
    chosen = fmt or ("csv" if paths[0].rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if chosen == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(*paths)
    if schema is None:
        raise ValueError("delimited text is read with an explicit schema")
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("dateFormat", date_pattern)
        .csv(paths)
    )


def parse_dates(
    df: DataFrame, patterns: Mapping[str, str], keep_time: bool | Sequence[str] = False
) -> DataFrame:
    """Turn text columns into dates (or zone-free timestamps); bad text is null.

    ``patterns`` maps column to pattern. ``keep_time`` is either a flag for all
    of them or the list of columns whose clock part is kept.
    """
    timed = set(patterns) if keep_time is True else set(keep_time or ())
    parsed = {}
    for name, pattern in patterns.items():
        stamp = F.try_to_timestamp(F.col(quoted(name)), F.lit(pattern))
        parsed[name] = stamp.cast("timestamp_ntz" if name in timed else "date")
    return df.withColumns(parsed)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a table for the next job; parquet keeps the column types."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("dateFormat", DATE_PATTERN).csv(path)
    else:
        writer.format(fmt).save(path)
