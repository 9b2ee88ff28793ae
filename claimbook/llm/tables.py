"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from claimbook.sources.scratch import remove, shared_folder

# Spark's own setting: the shuffle files of a query go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(schema: T.StructType, columns: str) -> T.StructType:
    """A schema with further columns, written as DDL, at its end."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(columns).fields])


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; lineage ends at the files."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class HandedOver:
    """Tables handed from step to step inside one operator, and deleted there.

    A table is computed once and its lineage ends at its files in the shared folder. The shuffle
    files of the query that wrote it are freed with it: nothing reads them any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path, before = shared_folder(self.spark), self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[1])

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all but these tables."""
        kept = {id(t) for t in tables}
        self.drop(*[t for t, _ in list(self.paths.values()) if id(t) not in kept])


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return pc.fill_null(column, "").to_pylist()


def slices(batches: Iterable[pa.RecordBatch], size: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose text and rows stay small.

    A piece ends after ``size`` rows or about ``limit`` bytes, so that one batch of
    very long texts is not expanded all at once.
    """
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(size, limit // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
