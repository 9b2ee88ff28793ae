"""Stages that apply the operators to a table of documents and return one of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimbook.llm import decontaminate, language, nearcopies, pieces, substrings
from claimbook.llm.queries import tokenizer_file
from claimbook.llm.tables import HandedOver, table

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing ``lang`` is filled with the prediction.

    Rejected are texts that are null or hold no letter, and those whose best language has a
    posterior below one half. The model learns from the stage's own labelled documents.
    """
    names = docs.columns
    said = language.predict(docs, language.fit(docs))
    kept = said.filter((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest ``doc_id`` of every group of near copies.

    Near copies share at least 0.8 of their 5-word shingles (Jaccard); SimHash fingerprints and
    MinHash bands of these propose the pairs. Rows with a null
    ``doc_id`` go where their group has a named document; of a group without one, one row stays.
    """
    return nearcopies.first_rows(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages an earlier one holds; those of which nothing stays go.

    A document that loses words keeps the others joined by one space, and its ``n_chars``
    follows; one that loses none keeps its text as it is.
    """
    # written apart, so that the search for repeats is done and freed before whole documents move
    cut = HandedOver(spark).write(substrings.remove_repeats(docs).filter("n_removed > 0").select(
        "doc_id", F.col("kept").alias("_kept")).dropDuplicates(["doc_id"]))
    joined = docs.join(cut, "doc_id", "left").filter("_kept is null or _kept <> ''")
    return joined.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(
        F.length("_kept").cast(docs.schema["n_chars"].dataType))).withColumn(
        "text", F.coalesce("_kept", "text")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other numbers, names or units."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with its language and source."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return pieces.sample_segmentations(rows, tokenizer_file("piece_bpe_32k.model"), k=2)
