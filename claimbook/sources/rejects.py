"""Delimited text in two outputs: rows that parse, and the others with the reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimbook.functions.semantics import free_name, quoted
from claimbook.sources.schemas import DATE_PATTERN


@dataclass(frozen=True)
class CheckedRead:
    """``kept`` has the declared columns; ``rejected`` has ``file, line, reason, n_problems``."""

    kept: DataFrame
    rejected: DataFrame

    def problems(self) -> DataFrame:
        """How often each reason occurs."""
        each = self.rejected.select(F.explode(F.split("reason", "; ")).alias("reason"))
        return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def _parsed(text: Column, kind: T.DataType, date_pattern: str) -> Column:
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(text, F.lit(date_pattern)).cast("date")
    if isinstance(kind, T.StringType):
        return text
    return text.try_cast(kind)


def read_checked(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    required: Sequence[str] = (),
    date_pattern: str = DATE_PATTERN,
) -> CheckedRead:
    """Scan delimited text with a header, keeping what does not parse apart.

    A row is rejected if it has more or fewer cells than the schema (reason ``cells``), a cell
    that does not parse as its declared type (``<column>: not <TYPE>``), or none in a column of
    ``required`` (``<column>: missing``); reasons are joined by ``; ``. ``line`` is the row's
    text. An empty cell is null. The cells are read as text once per output and parsed by column
    expressions, without a Python step.
    """
    paths = [path] if isinstance(path, str) else list(path)
    broken = free_name("_broken", schema.names)
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema], T.StructField(broken, T.StringType())])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", broken)
        .csv(paths)
    )
    cells = {f.name: F.col(quoted(f.name)) for f in schema}
    values = {f.name: _parsed(cells[f.name], f.dataType, date_pattern) for f in schema}
    wrong = [
        F.when(cells[f.name].isNotNull() & values[f.name].isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString().upper()}"))
        for f in schema if not isinstance(f.dataType, T.StringType)]
    wrong += [F.when(cells[c].isNull(), F.lit(f"{c}: missing")) for c in required]
    is_broken = F.col(quoted(broken)).isNotNull()
    reasons = F.when(is_broken, F.array(F.lit("cells"))).otherwise(F.array_compact(F.array(*wrong)))
    line = F.coalesce(F.col(quoted(broken)), F.to_csv(F.struct(*cells.values())))
    bad = F.size(reasons) > 0
    return CheckedRead(
        raw.filter(~bad).select(*[values[n].alias(n) for n in schema.names]),
        raw.filter(bad).select(
            F.col("_metadata.file_path").alias("file"), line.alias("line"),
            F.concat_ws("; ", reasons).alias("reason"), F.size(reasons).alias("n_problems")),
    )
