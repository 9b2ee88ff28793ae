"""Near copies by SimHash and MinHash of their word shingles, and their exact Jaccard similarity.

Pairs are proposed in two ways: by SimHash fingerprints that differ in at most two bits, found by
the anchors of ``simhash``, and by MinHash bands for copies whose fingerprints lie further apart
(at a similarity of 0.8 about ten bits, beyond any covering of 64 bits). Every proposed pair is
compared word by word. A pair of similarity s shares no band with probability
(1 - s**ROWS)**BANDS: 3 in a million at 0.8, less above.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimbook.functions.semantics import free_name, quoted
from claimbook.llm import simhash
from claimbook.llm.components import smallest_reachable
from claimbook.llm.tables import HandedOver, slices, texts_of, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
PIVOT_ROUNDS = 2
MEMO = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_seeded = np.random.default_rng(5)
FACTORS = _seeded.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _seeded.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str, words: int = WORDS) -> frozenset[tuple[str, ...]]:
    """The distinct runs of lower-cased words; a shorter text is one run."""
    w = text.lower().split()
    return frozenset(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else frozenset([tuple(w)])


def vertex(text: Column) -> Column:
    """What stands for a text: exact copies are one vertex."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class _Signer:
    def __init__(self):
        self.memo: dict[str, int] = {}

    def shingles(self, text: str, words: int) -> np.ndarray:
        """A 64-bit hash of every shingle of ``shingles``, repeats included."""
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, out = self.memo, []
        for word in text.lower().split():
            h = memo.get(word)
            if h is None:
                memo[word] = h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            out.append(h)
        w = np.array(out, np.uint64)
        n = max(1, len(w) - words + 1)
        h = np.full(n, len(w) if len(w) < words else words, np.uint64)
        for i in range(min(words, len(w))):
            h = (h ^ w[i : n + i]) * MIX
            h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def bands(h: np.ndarray) -> np.ndarray:
        least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), 4096):
            least = np.minimum(least, (h[at : at + 4096, None] * FACTORS + TERMS).min(axis=0))
        band = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            band = (band ^ column) * MIX
            band ^= band >> np.uint64(29)
        return band.view(np.int64)


def _signed(words: int):
    """``v, text`` to ``v, fp, bands``: fingerprint and bands of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer()
        for batch in slices(batches, 1024):
            fp, bands = [], []
            for t in texts_of(batch.column(1)):
                h = signer.shingles(t, words)
                fp.append(simhash.majority(h))
                bands.append(signer.bands(h))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(BANDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bands)))], names=["v", "fp", "bands"])

    return run


def _sets(words: int):
    """``v, label, text`` to ``v, label, n, shingles``: the hashes of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer()
        for batch in slices(batches, 1024):
            found = [np.unique(signer.shingles(t, words)) for t in texts_of(batch.column(2))]
            sizes = np.array([len(h) for h in found], np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64)))],
                names=["v", "label", "n", "shingles"])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    """``v, w`` as distinct ``a < b``."""
    return pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def close_fingerprints(signed: DataFrame, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Pairs of vertices in ``v, fp`` whose fingerprints differ in at most two bits.

    Of the vertices with one fingerprint the least stands for all and is paired with each of them.
    """
    marked = signed.select("v", "fp").distinct()
    one = write(marked.groupBy("fp").agg(F.min("v").alias("w")))
    same = marked.join(one, "fp").filter("v <> w").select("v", "w")
    far = simhash.links(one.select("fp")).join(one.select(F.col("fp").alias("a"), F.col("w").alias("v")), "a")
    return _ordered(same.unionByName(far.join(one.select(F.col("fp").alias("b"), "w"), "b").select("v", "w")))


def rare_first(sets: DataFrame, similarity: float, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Pairs ``a < b`` of vertices with different labels in ``v, label, n, shingles`` that may be similar.

    All shingles are put in one order: first those that only one label holds, the others from the
    rarest to the most frequent. What two sets share lies behind the first shingle they share, so a
    pair that reaches the similarity meets at a shingle with enough left behind it in both sets,
    and no such pair is lost. Texts that have a pattern in common and enough words of their own do
    not meet at the pattern. A shingle's most frequent label is only paired with the others.
    """
    each = sets.select("v", "label", "n", F.explode("shingles").alias("h"))
    mixed = each.groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.filter("low < high").select("h", "held")
    least = F.col("n") * similarity - 1e-6
    sorted_ = each.join(mixed, "h").groupBy("v", "label", "n").agg(F.collect_list(F.struct("held", "h")).alias("t")).filter(
        F.size("t") >= least).withColumn("t", F.sort_array("t"))
    placed = sorted_.select("v", "label", "n", F.size("t").alias("m"), F.posexplode("t").alias("at", "e"))
    starts = write(placed.select("v", "label", "n", F.col("e.h").alias("h"), (F.col("m") - F.col("at")).alias("rest")).filter(
        F.col("rest") >= least))
    leading = starts.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(
        F.max(F.struct("n", "label")).alias("lead"))
    one = starts.join(leading, "h").filter("label <> lead.label").drop("lead")
    two = starts.select("h", *[F.col(c).alias(f"{c}_2") for c in ("v", "label", "n", "rest")])
    both = F.least("rest", "rest_2")
    enough = both >= similarity * (F.col("n") + F.col("n_2") - both) - 1e-6
    return _ordered(one.join(two, (one["h"] == two["h"]) & (F.col("label") != F.col("label_2")) & enough).select(
        "v", F.col("v_2").alias("w")))


def _similar(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: OrderedDict[bytes, frozenset] = OrderedDict()

        def known(v: bytes, text: str) -> frozenset:
            found = memo.get(v)
            if found is None:
                memo[v] = found = shingles(text, words)
                if len(memo) > 256:
                    memo.popitem(last=False)
            return found

        for batch in slices(batches, 256):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (s, t) in enumerate(zip(texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True)):
                x, y = known(a[i], s), known(b[i], t)
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def labels(docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``v, label`` of the texts that share a band or a close fingerprint with another: linked vertices share a label.

    Linked are texts whose sets of ``words``-word shingles have a Jaccard similarity of at
    least ``similarity``. Pairs with close fingerprints are compared, and each band's members
    with one of them, in rounds, so a group of near copies costs a star. What then is in a band
    with two groups is compared with every text of another group that its rarest shingles leave
    possible, with no limit on what a band holds. Tables between the steps are deleted when the
    labels are written.
    """
    handed = HandedOver(docs.sparkSession)
    write = handed.write
    rows = docs.select(vertex(F.col(text)).alias("v"), F.col(text).alias("text"))
    signed = write(rows.mapInArrow(_signed(words), "v binary, fp long, bands array<long>"))
    close = write(close_fingerprints(signed, write))
    bands = write(signed.select("v", F.explode("bands").alias("band")).distinct())
    handed.keep_only(close, bands)
    several = bands.groupBy("band").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low < high")
    members = write(bands.join(several.select("band"), "band"))
    handed.drop(bands)
    vertices = write(members.select("v").union(close.select("a")).union(close.select("b")).distinct())
    texts = write(rows.join(vertices, "v", "left_semi").groupBy("v").agg(F.min("text").alias("text")))
    checked = links = None
    label = vertices.select("v", F.col("v").alias("label"))
    for at in range(PIVOT_ROUNDS + 1):
        held = members.join(label, "v")
        pivot = F.min(F.struct(F.xxhash64("v", F.lit(at)).alias("h"), F.col("v").alias("v"), F.col("label").alias("label")))
        mixed = held.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), pivot.alias("p"))
        mixed = mixed.filter("low < high")
        if at < PIVOT_ROUNDS:
            near = held.join(mixed.select("band", "p"), "band").filter("label <> p.label").select("v", F.col("p.v").alias("w"))
            pairs = _ordered(near if at else near.union(close))
        else:
            left = held.join(mixed.select("band"), "band").select("v", "label").distinct()
            sets = write(left.join(texts, "v").select("v", "label", "text").mapInArrow(
                _sets(words), "v binary, label binary, n int, shingles array<long>"))
            pairs = rare_first(sets, similarity, write)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = write(pairs)
        if pairs.isEmpty():
            continue
        checked = pairs if checked is None else checked.unionByName(pairs)
        one = texts.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
        found = write(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
                      .mapInArrow(_similar(words, similarity), "a binary, b binary"))
        links = found if links is None else links.unionByName(found)
        label = smallest_reachable(links, vertices, "v", "v", write)
        label = write(label)
    if links is None:
        label = write(label)
    handed.keep_only(label)
    return label


def first_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
               similarity: float = SIMILARITY) -> DataFrame:
    """One row of every group of near copies: that with the smallest key, a null key only if there is no other.

    Texts without a word are copies of each other. Rows that share a key are grouped by their
    own texts. An empty table gives no rows.
    """
    handed = HandedOver(docs.sparkSession)
    v, k, missing = (free_name(n, docs.columns) for n in ("_v", "_key", "_missing"))
    named = docs.select(vertex(F.col(quoted(text))).alias("v"), F.col(quoted(key)).alias("first"))
    firsts = named.groupBy("v").agg(F.min("first").alias("first"))
    group = labels(docs, text, words, similarity)
    best = F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "v")).alias("b")
    chosen = handed.write(firsts.join(group, "v", "left").groupBy(F.coalesce("label", "v").alias("g")).agg(best).select(
        "b.v", "b.first"))

    # The row's own identity is the key of the join and of the repeats, so texts move once.
    def identity(of_text: Column, of_key: Column) -> list[Column]:
        return [of_text.alias(v), F.coalesce(of_key.cast("string"), F.lit("")).alias(k), of_key.isNull().alias(missing)]

    rows = docs.select("*", *identity(vertex(F.col(quoted(text))), F.col(quoted(key))))
    return rows.join(chosen.select(*identity(F.col("v"), F.col("first"))), [v, k, missing], "left_semi").dropDuplicates(
        [v, k, missing]).select(*[quoted(c) for c in docs.columns])
