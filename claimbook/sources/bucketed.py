"""Feature tables kept in buckets of their key, so that later joins on it move no rows.

A bucketed table should hold one row per key: a bucket is read by one task, and a key of many rows
would make one bucket large. Histories are reduced to a row per key before they are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted
from claimbook.sources.scratch import remove, shared_folder


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store a table in ``buckets`` files by the hash of ``key``, sorted by it, and return its scan.

    The rows are shuffled once, to the tasks that write the buckets, so every bucket is one file.
    Tables that are joined to each other take the same number of buckets.
    """
    spark = df.sparkSession
    df.repartition(buckets, F.col(quoted(key))).write.bucketBy(buckets, key).sortBy(key).option(
        "path", path or shared_folder(spark)).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """Register files that an earlier session stored by ``write_bucketed``; nothing is rewritten.

    ``schema`` is a column list as in a table definition.
    """
    at = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {quoted(name)} ({schema}) USING parquet CLUSTERED BY ({quoted(key)}) SORTED BY ({quoted(key)}) "
        f"INTO {int(buckets)} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def location(spark: SparkSession, name: str) -> str:
    """Folder of a stored table."""
    facts = spark.sql(f"DESCRIBE FORMATTED {quoted(name)}")
    return facts.filter("col_name = 'Location'").first()["data_type"]


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget a stored table and delete its files."""
    path = location(spark, name)
    spark.sql(f"DROP TABLE {quoted(name)}")
    remove(spark, path)
