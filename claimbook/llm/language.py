"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimbook.llm.tables import plus, slices, texts_of

UNDECIDED = "und"
LETTER = regex.compile(r"\p{L}")
BITS = 15
ORDERS = (1, 2, 3)
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Log-probability of each hashed n-gram per language, and the log-priors.

    Its size is ``languages * 2**BITS * 4`` bytes whatever the corpus is.
    """

    languages: tuple[str, ...]
    log_p: np.ndarray
    prior: np.ndarray


def buckets(text: str) -> np.ndarray:
    """Bucket of every character n-gram of a lower-cased text, spaces folded and padded."""
    folded = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        found.append(h >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int64)


def is_held_out(key: str):
    """True for the fold that no model learns from: crc32 of the key's text divisible by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in slices(batches, 512):
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            if lang not in sums:
                sums[lang] = np.zeros(1 << BITS, np.int64)
            sums[lang] += np.bincount(buckets(text), minlength=1 << BITS)
            docs[lang] = docs.get(lang, 0) + 1
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(at) + 1), pa.string()),
                pa.array(np.append(at, -1), pa.int64()),
                pa.array(np.append(total[at], docs[lang]), pa.int64()),
            ],
            names=["lang", "bucket", "n"],
        )


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
        max_rows_per_language: int = 5_000, smoothing: float = 0.5) -> Model:
    """Fit on labelled rows outside the held-out fold.

    A language with more than ``max_rows_per_language`` such rows is fitted on
    about that many, chosen by a hash of the key and text; that parameter bounds the
    fit and nothing else. Rows without label or text teach nothing.
    """
    labelled = docs.select(
        F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"),
        is_held_out(key).alias("held_out"),
    ).filter("lang is not null and text is not null and not held_out")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    keep = F.lit(1.0)
    for lang, n in counts.items():
        if n > max_rows_per_language:
            keep = F.when(F.col("lang") == lang, max_rows_per_language / n).otherwise(keep)
    chosen = labelled.filter(
        F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < F.ceil(keep * 1_000_000)
    ).select("lang", "text")
    sums = (
        chosen.mapInArrow(_partial_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    languages = tuple(sorted(set(sums["lang"].to_pylist())))
    table = np.zeros((1 << BITS, len(languages)))
    prior = np.zeros(len(languages))
    column = np.array([languages.index(x) for x in sums["lang"].to_pylist()])
    at, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    prior[column[at < 0]] = n[at < 0]
    table[at[at >= 0], column[at >= 0]] = n[at >= 0]
    table += smoothing
    log_p = np.log(table / table.sum(axis=0)).astype(np.float32)
    return Model(languages, log_p, np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, from the text alone.

    Null texts, texts without a letter and an empty model give ``und`` with score 0.
    The score is the posterior of the predicted language. Ties go to the language
    that sorts first. Existing columns of these two names are replaced. Whole texts
    are read; repeated rows are scored alike.
    """
    rows = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.schema
    position = rows.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 512):
            names, scores = [], []
            for t in texts_of(batch.column(position)):
                if not m.languages or not LETTER.search(t):
                    names.append(UNDECIDED)
                    scores.append(0.0)
                    continue
                b = buckets(t)
                seen = np.bincount(b, minlength=1 << BITS) if len(b) > 1 << BITS else None
                total = (seen @ m.log_p.astype(np.float64) if seen is not None
                         else m.log_p[b].sum(axis=0, dtype=np.float64)) + m.prior
                p = np.exp(total - total.max())
                names.append(m.languages[int(p.argmax())])
                scores.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return rows.mapInArrow(score, plus(schema, "lang_pred string, score double"))
