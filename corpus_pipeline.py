"""From raw documents to sampled token sequences, in five stages.

Each stage is handed everything its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimbook.llm import stages
from claimbook.llm.tables import HandedOver, table

STAGES = [
    ("language", stages.identify_language),
    ("near_duplicates", stages.drop_near_duplicates),
    ("repeated_passages", stages.cut_repeats),
    ("decontamination", stages.drop_contaminated),
    ("segmentation", stages.encode),
]

# Sampled segmentations and a fitted classifier have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    handed = HandedOver(spark)
    for _, stage in STAGES[:-1]:
        docs = handed.write(stage(spark, docs, sf_dir))
        handed.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
