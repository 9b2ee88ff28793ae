"""Cross-entropy difference between matched n-gram models of a target and the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimbook.llm.tables import plus, slices, texts_of, written

WORD_BITS = 18  # 2**18 words at least share the floor of the word model, or as many as there are
PAIR_BITS = 20  # pairs that are one of 2**20 tokens or more are broadcast; there are at most 2**20 of those
MEMO = 400_000
CHUNK = 2_000_000
DISCOUNT_MASS = 50.0
FLOOR = 0.5
START = 0  # in place of the word before the first


@dataclass(frozen=True)
class Models:
    """Exact counts of words and word pairs in the target and the background, by 64-bit hashes of words.

    ``words`` has ``word, target, background`` and ``pairs`` has ``a, b, n, target_loss,
    background_loss``, the loss of ``b`` after ``a`` (``START`` at the head of a text) and
    the pair's number in the background. Both are files that grow with the corpus.
    """

    words: DataFrame
    pairs: DataFrame
    totals: tuple[int, int]
    vocabulary: int

    def losses(self, pair: tuple[Column, Column], before: tuple[Column, Column], word: tuple[Column, Column],
               first: Column) -> list[Column]:
        """Negative log-probability of a word under both models, natural log, from its counts.

        A pair model with a Dirichlet prior on the smoothed word model; the first token of a
        text has the word model alone.
        """
        out = []
        for m in range(2):
            base = (word[m] + FLOOR) / (self.totals[m] + FLOOR * self.vocabulary)
            p = (pair[m] + DISCOUNT_MASS * base) / (before[m] + DISCOUNT_MASS)
            out.append(-F.log(F.when(first, base).otherwise(p)))
        return out


class _Hasher:
    def __init__(self):
        self.code: dict[str, int] = {}
        self.hash: list[int] = []

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the word before every token and of the token, of the texts in a row, and the text lengths."""
        if len(self.hash) > MEMO:
            self.__init__()
        get, out, lengths = self.code.get, [], []
        for text in texts:
            words = text.lower().split()
            lengths.append(len(words))
            for word in words:
                at = get(word)
                if at is None:
                    self.code[word] = at = len(self.hash)
                    self.hash.append(xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1)
                out.append(at)
        lengths = np.array(lengths, np.int64)
        b = np.array(self.hash, np.uint64)[np.array(out, np.int64)]
        a = np.concatenate([np.zeros(1, np.uint64), b[:-1]])[: len(b)]
        a[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
        return a, b, lengths


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _counted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, chosen = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, chosen = a[order], b[order], chosen[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    n = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays(
        [pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)),
         pa.array(np.add.reduceat(chosen.astype(np.int64), first)), pa.array(n)],
        names=["a", "b", "target", "background"],
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, parts, held = _Hasher(), [], 0
    for batch in slices(batches, 2048):
        a, b, lengths = hasher.pairs(texts_of(batch.column(0)))
        if not len(b):
            continue
        parts.append((a, b, np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), lengths)))
        held += len(b)
        if held >= CHUNK:
            yield _counted(parts)
            parts, held = [], 0
    if parts:
        yield _counted(parts)


def fit(docs: DataFrame, is_target: str, text: str = "text") -> Models:
    """Count both models over all rows: the background is every text, the target those flagged.

    Tasks add up what they read in sorted pieces and Spark sums them by pair; words are
    summed from the pairs they end. Null texts count nothing; a null flag is no target.
    """
    rows = docs.select(F.col(text), F.coalesce(F.col(is_target), F.lit(False)).alias("chosen"))
    both = [F.sum(c).alias(c) for c in ("target", "background")]
    counts = written(rows.mapInArrow(_counts, "a long, b long, target long, background long").groupBy("a", "b").agg(*both))
    words = written(counts.groupBy(F.col("b").alias("word")).agg(*both))
    n, target, background = words.agg(F.count(F.lit(1)), F.sum("target"), F.sum("background")).first()
    models = Models(words, counts, (target or 0, background or 0), max(1 << WORD_BITS, n))
    columns = _with_words(counts, models)
    losses = models.losses((F.col("target"), F.col("background")), *columns[1], F.col("a") == START)
    pairs = written(columns[0].select("a", "b", F.col("background").alias("n"),
                                      losses[0].alias("target_loss"), losses[1].alias("background_loss")))
    return Models(words, pairs, models.totals, models.vocabulary)


def _with_words(pairs: DataFrame, models: Models):
    """The pairs with the counts of their words, and the columns of those: before, word."""
    out, columns = pairs, []
    for side in ("a", "b"):
        names = [f"{side}_target", f"{side}_background"]
        out = out.join(models.words.select(F.col("word").alias(side), F.col("target").alias(names[0]),
                                           F.col("background").alias(names[1])), side, "left")
        columns.append(tuple(F.coalesce(c, F.lit(0)) for c in names))
    return out, columns


def _rows(position: int, kept: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (hot, *losses) = _Hasher(), shared.value
        hashes = _mixed(hot[0], hot[1])
        order = np.argsort(hashes)
        hashes, a_hot, b_hot = hashes[order], hot[0][order], hot[1][order]
        losses = [x[order] for x in losses]
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1024):
            a, b, lengths = hasher.pairs(texts_of(batch.column(position)))
            ends = np.cumsum(lengths)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, _mixed(a, b)), len(hashes) - 1)
                known = (a_hot[at] == a) & (b_hot[at] == b)
            else:
                at, known = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
            sums = []
            for x in losses:
                total = np.concatenate([[0.0], np.cumsum(np.where(known, x[at] if len(x) else 0.0, 0.0))])
                sums.append(pa.array(total[ends] - total[ends - lengths]))
            cold = np.flatnonzero(~known)
            offsets = pa.array(np.concatenate([[0], np.cumsum(~known)])[np.concatenate([[0], ends])], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(np.arange(row, row + batch.num_rows)), pa.array(lengths), *sums,
                 *[pa.ListArray.from_arrays(offsets, pa.array(x[cold].view(np.int64))) for x in (a, b)]],
                names=[*[batch.schema.names[i] for i in kept], "_row", "n_tokens", "_target", "_background", "_a", "_b"],
            )
            row += batch.num_rows

    return run


def score(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The rows with ``n_tokens, target_loss, background_loss, difference`` in place of their text.

    Losses are means per token in nats; ``difference`` is target minus background, so lower is
    closer to the target. Texts that are null or hold no word have 0 tokens and null losses.
    Existing columns of the four names are replaced; whole texts are read. Pairs that are one
    of 2**20 tokens or more are looked up in a broadcast table, all others by a join, where no
    key is frequent; words and pairs that were not counted are counted as zero.
    """
    rows = docs.drop("n_tokens", "target_loss", "background_loss", "difference")
    position = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if i != position]
    frequent = models.pairs.filter(F.col("n") > models.totals[1] >> PAIR_BITS).drop("n").toArrow()
    hot = [frequent[c].to_numpy().view(np.uint64) for c in ("a", "b")]
    shared = docs.sparkSession.sparkContext.broadcast(
        (hot, *[frequent[c].to_numpy() for c in ("target_loss", "background_loss")]))
    heads = written(rows.mapInArrow(_rows(position, kept, shared), plus(
        rows.drop(text).schema,
        "_row long, n_tokens long, _target double, _background double, _a array<long>, _b array<long>")))

    def cold(df: DataFrame) -> DataFrame:
        zipped = F.explode(F.arrays_zip(F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("p")
        return df.select("_row", zipped).select("_row", F.col("p.a").alias("a"), F.col("p.b").alias("b"))

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("_row").agg(F.sum("target_loss").alias("_t"), F.sum("background_loss").alias("_g"),
                                      F.count_if(F.col("target_loss").isNull()).alias("_unseen"))

    found = written(summed(cold(heads).join(models.pairs.drop("n").hint("merge"), ["a", "b"], "left")))
    extra = found.filter("_unseen > 0").select("_row")
    if not extra.isEmpty():
        new = cold(heads.join(extra, "_row", "left_semi")).join(models.pairs, ["a", "b"], "left_anti")
        new, columns = _with_words(new, models)
        zero = F.lit(0)
        losses = models.losses((zero, zero), *columns, F.col("a") == START)
        new = summed(new.select("_row", losses[0].alias("target_loss"), losses[1].alias("background_loss")))
        found = found.unionByName(new).groupBy("_row").agg(F.sum("_t").alias("_t"), F.sum("_g").alias("_g"))
    target, background = (
        F.when(F.col("n_tokens") > 0, (F.col(near) + F.coalesce(far, F.lit(0.0))) / F.col("n_tokens"))
        for near, far in (("_target", "_t"), ("_background", "_g")))
    return heads.drop("_a", "_b").join(found.select("_row", "_t", "_g"), "_row", "left").select(
        *[c for c in rows.columns if c != text], "n_tokens", target.alias("target_loss"),
        background.alias("background_loss"), (target - background).alias("difference"))
