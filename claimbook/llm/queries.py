"""Registered queries over the synthetic tables, one per training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimbook.llm import alignment, contrast, decontaminate, language, licences, merkle, pieces, secretscan, shards, simhash, substrings, tokens, topk
from claimbook.llm.tables import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, each with the mixture of sources."""
    placed = shards.interleave(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products for every hundredth vector."""
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 13 words that an earlier one holds."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, as digests of their piece ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sampled = pieces.sample_segmentations(docs, tokenizer_file("piece_bpe_32k.model"), k=2)
    return sampled.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_digest"),
        "log_p", "perturbed", "inclusion", "round_trip",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every page, its own or inherited from the nearest directory."""
    return licences.scan(table(spark, sf_dir, "pages"))


def op7_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's loss under a model of the good documents less that under all documents.

    Labels grow with the corpus, so they are joined by key at every size.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    return contrast.score_corpus(docs.join(good.hint("merge"), "doc_id", "left"), "good").drop("good")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", language.is_held_out("doc_id").alias("held_out"))
    return language.predict(rows, language.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by rules and by a network learned from the rules' findings."""
    return secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document, and how usual its links are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document against the Merkle manifest of all, every seventh one being altered."""
    return merkle.tampering_trial(table(spark, sf_dir, "documents"))


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Query and check SQL by name; None where SQL has no form for it."""
    return {
        "op1_shards": (op1_shards, shards.SQL),
        "op2_top_k": (op2_top_k, topk.SQL),
        "op3_substrings": (op3_substrings, substrings.SQL),
        "op4_segmentations": (op4_segmentations, None),
        "op5_token_counts": (op5_token_counts, None),
        "op6_licences": (op6_licences, licences.SQL),
        "op7_lm_difference": (op7_lm_difference, None),
        "op8_simhash": (op8_simhash, None),
        "op9_language": (op9_language, None),
        "op10_decontamination": (op10_decontamination, None),
        "op11_secrets": (op11_secrets, None),
        "op12_alignment": (op12_alignment, None),
        "op13_manifest": (op13_manifest, merkle.SQL),
    }
