"""Folder for tables handed from one job to the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A fresh path that every executor and the driver can reach.

    It lies below the folder named in ``spark.checkpoint.dir``, else below the
    session's warehouse folder; both are shared on a cluster. No folder of a
    single machine is ever used.
    """
    root = (
        spark.conf.get(SETTING, None)
        or spark.sparkContext.getConf().get(SETTING, None)
        or spark.conf.get("spark.sql.warehouse.dir") + "/_handed_over"
    )
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a handed-over table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and return the scan of it.

    For results that several passes read: they are computed once, the lineage
    ends at the files, and a lost executor costs a reread instead of a rerun.
    """
    path = shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
