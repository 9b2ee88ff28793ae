"""Cross-entropy difference of every document of the corpus that both models are counted on.

Counting and scoring meet in one exchange. The loss of word b after word a falls into a part
of the pair, ``-log(n(a, b) + D * base(b))``, and a part of the word before, ``log(n(a) + D)``.
All tokens of one word go to one part of the exchange, so its count, the counts of its pairs
and both parts of the losses are known there; sums per document come back to the chunk of
documents they were read in. Words that are one of 2**HOT_BITS tokens or more are broadcast
with their exact counts, and so are the counts of the pairs of two such words; a frequent word after a rare one is dealt by the pair. No part holds a key
of more than 2**-HOT_BITS of all tokens. Tokens and sums travel as packed blocks, not as rows:
a document meets ever more parts as the corpus grows, but never more than it has tokens.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimbook.llm.lm import DISCOUNT_MASS, FLOOR, START
from claimbook.llm.tables import HandedOver, slices, texts_of

HOT_BITS = 9
PART = 2_000_000  # tokens dealt to one part of the exchange, about
CHUNK = 2_000_000  # tokens packed at once
MEMO = 400_000  # words a task remembers
LONG = 1 << 20  # longer texts are read piece by piece
SPACE = re.compile(r"\s")
TOKENS, SUMS = 0, 1
PIECE = 4 << 20  # bytes of text read at once
BLOCK = "source long, part int, kind int, block binary"
CHOSEN, FOLLOWED = 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)
TOKEN_TYPES = (np.uint64, np.int32, np.int32, np.int64, np.int32, np.uint8)
SUM_TYPES = (np.int64, np.int64, np.float64, np.float64)


def _pieces(text: str) -> Iterator[str]:
    """The text, cut after spaces where it is long."""
    at = 0
    while len(text) - at > LONG:
        space = SPACE.search(text, at + LONG)
        if space is None:
            break
        yield text[at : space.end()]
        at = space.end()
    yield text[at:] if at else text


class _Words:
    """Numbers of the words a task has seen, in order of appearance, and their hashes."""

    def __init__(self):
        self.code: dict[str, int] = defaultdict(itertools.count().__next__)
        self.hash = np.zeros(0, np.uint64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of the texts in a row, and the words of each text."""
        number, parts, lengths = self.code.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for piece in _pieces(text):
                words = piece.lower().split()
                lengths[i] += len(words)
                parts.append(np.fromiter(map(number, words), np.int32, len(words)))
        new = [xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
               for w in itertools.islice(self.code, len(self.hash), None)]
        self.hash = np.concatenate([self.hash, np.array(new, np.uint64)])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), lengths

    def before(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the word before each token, -1 at the head of a text; whether one follows."""
        ends = np.cumsum(lengths)
        full = lengths > 0
        a = np.concatenate([np.full(1, -1, np.int32), codes[:-1]])[: len(codes)]
        a[(ends - lengths)[full]] = -1
        followed = np.ones(len(codes), bool)
        followed[ends[full] - 1] = False
        return a, followed


def _place(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted ones, -1 where it is not there."""
    if not len(sorted_hashes):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == hashes, at, -1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, the bytes of equal rank together."""
    out = [np.array([len(x) for x in arrays], np.int64).tobytes()]
    out += [np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(block: bytes, types) -> list[np.ndarray]:
    raw, out = zstandard.ZstdDecompressor().decompress(block), []
    at = 8 * len(types)
    for n, kind in zip(np.frombuffer(raw, np.int64, len(types)).tolist(), types, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def _word_counts(memo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = _Words(), np.zeros((2, 0), np.int64)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(words.hash.view(np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                names=["word", "target", "background"])

        for batch in slices(batches, 2048, PIECE):
            codes, lengths = words.read(texts_of(batch.column(0)))
            chosen = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), lengths)
            n = len(words.hash)
            sums = np.pad(sums, ((0, 0), (0, n - sums.shape[1])))
            sums += np.stack([np.bincount(codes[chosen], minlength=n), np.bincount(codes, minlength=n)])
            if n > memo:
                yield counted()
                words, sums = _Words(), np.zeros((2, 0), np.int64)
        if len(words.hash):
            yield counted()

    return run


def _hot_pairs(hot: np.ndarray, memo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = _Words(), len(hot)
        sums = np.zeros((2, size * size), np.int64)
        for batch in slices(batches, 2048, PIECE):
            if len(words.hash) > memo:
                words = _Words()
            codes, lengths = words.read(texts_of(batch.column(0)))
            chosen = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), lengths)
            a, _ = words.before(codes, lengths)
            place = np.append(_place(hot, words.hash), -1)  # the last one for -1, no word
            both = np.flatnonzero((place[codes] >= 0) & (place[a] >= 0))
            pair, chosen = place[a[both]] * size + place[codes[both]], chosen[both]
            sums[0] += np.bincount(pair[chosen], minlength=size * size)
            sums[1] += np.bincount(pair, minlength=size * size)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])],
                                         names=["pair", "target", "background"])

    return run


class _Known:
    """What every task knows: totals, the frequent words with their counts and their pairs' counts."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray, pairs: np.ndarray, totals, vocabulary: int):
        self.hot, self.counts, self.totals, self.vocabulary = hot, counts, totals, vocabulary
        base = np.stack([self.base(counts[m], m) for m in range(2)])
        self.first = -np.log(base)
        self.after = np.log(counts + DISCOUNT_MASS)
        self.pair = -np.log(pairs.reshape(2, len(hot), len(hot)) + DISCOUNT_MASS * base[:, None, :])

    def base(self, count: np.ndarray, m: int) -> np.ndarray:
        return (count + FLOOR) / (self.totals[m] + FLOOR * self.vocabulary)


def _row(source: int, part: int, kind: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([source], pa.int64()), pa.array([part], pa.int32()), pa.array([kind], pa.int32()),
         pa.array([block], pa.binary())], names=["source", "part", "kind", "block"])


def _blocks(shared, parts: int, chunk: int, memo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, held, size, source = shared.value, _Words(), [], 0, 0

        def dealt() -> Iterator[pa.RecordBatch]:
            b, a, rows, flags, part = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            b, a, rows, flags, part = b[order], a[order], rows[order], flags[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            local = np.empty(len(words.hash) + 1, np.int32)
            local[-1] = -1
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                used = np.unique(np.concatenate([b[x:y], a[x:y]]))
                used = used[used >= 0]
                local[used] = np.arange(len(used))
                names, which = np.unique(rows[x:y], return_inverse=True)
                yield _row(source, int(part[x]), TOKENS, _packed(
                    words.hash[used], local[b[x:y]], local[a[x:y]], names, which.astype(np.int32), flags[x:y]))

        for batch in slices(batches, 2048, PIECE):
            if len(words.hash) > memo:
                if held:
                    yield from dealt()
                words, held, size = _Words(), [], 0
            codes, lengths = words.read(texts_of(batch.column(0)))
            rows = batch.column(2).to_numpy()
            source = source if held else int(rows[0])  # all tokens of a document have one source
            a, followed = words.before(codes, lengths)
            owner = np.repeat(np.arange(len(rows)), lengths)
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[owner]
            place = np.append(_place(known.hot, words.hash), -1)
            hot_b, hot_a = place[codes], place[a]
            here = np.flatnonzero((hot_b >= 0) & ((hot_a >= 0) | (a < 0)))
            after = np.flatnonzero((hot_b >= 0) & followed)
            near = []
            for m in range(2):
                loss = np.zeros(len(codes))
                x, y = hot_a[here], hot_b[here]
                loss[here] = np.where(x >= 0, known.pair[m][x, y], known.first[m][y])
                loss[after] += known.after[m][hot_b[after]]
                near.append(np.bincount(owner, loss, minlength=len(rows)).astype(np.float64))
            yield _row(source, int(rows[0]) % parts, SUMS, _packed(rows, lengths, *near))
            away = np.ones(len(codes), bool)
            away[here] = False
            away = np.flatnonzero(away)
            if not len(away):
                continue
            hashes = np.append(words.hash, np.uint64(START))
            key = hashes[codes[away]] * MIX
            mixed = np.flatnonzero(hot_b[away] >= 0)
            key[mixed] = (key[mixed] ^ hashes[a[away][mixed]]) * MIX
            part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            held.append((codes[away], a[away], rows[owner[away]],
                         (chosen[away] * CHOSEN + followed[away] * FOLLOWED).astype(np.uint8), part))
            size += len(away)
            if size >= chunk:
                yield from dealt()
                held, size = [], 0
        if held:
            yield from dealt()

    return run


def _losses(known: _Known, tokens: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Sums over the tokens of one part, by block and document."""
    sources, names, *columns = zip(*tokens, strict=True)
    ends = np.cumsum([len(x) for x in names])
    b, a, flags = (np.concatenate(x) for x in columns[:3])
    owner = np.concatenate([x + (end - len(n)) for x, n, end in zip(columns[3], names, ends.tolist(), strict=True)])
    order = np.lexsort((a, b))
    b, a, flags, owner = b[order], a[order], flags[order], owner[order]
    word = np.concatenate([[True], b[1:] != b[:-1]])
    pair = np.flatnonzero(word | np.concatenate([[True], a[1:] != a[:-1]]))
    word = np.flatnonzero(word)
    per_word, per_pair = np.diff(np.append(word, len(b))), np.diff(np.append(pair, len(b)))
    place = _place(known.hot, b[word])
    follows = np.flatnonzero(np.repeat(place < 0, per_word) & (flags & FOLLOWED > 0))
    first = a == START
    sums = []
    for m, one in enumerate((flags & CHOSEN, np.ones(len(b), np.uint8))):
        n = np.add.reduceat(one, word, dtype=np.int64)
        n = np.where(place >= 0, known.counts[m][place] if len(known.hot) else 0, n)
        base = np.repeat(known.base(n, m), per_word)
        seen = np.repeat(np.add.reduceat(one, pair, dtype=np.int64), per_pair)
        loss = -np.log(np.where(first, base, seen + DISCOUNT_MASS * base))
        loss[follows] += np.repeat(np.log(n + DISCOUNT_MASS), per_word)[follows]
        sums.append(np.bincount(owner, loss, minlength=int(ends[-1])))
    for source, rows, end in zip(sources, names, ends.tolist(), strict=True):
        at = slice(end - len(rows), end)
        yield _row(source, 0, SUMS, _packed(rows, np.zeros(len(rows), np.int64), sums[0][at], sums[1][at]))


def _part_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens, current = shared.value, [], None
        for batch in batches:
            for source, part, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == SUMS:
                    yield _row(source, part, kind, block)
                    continue
                if part != current and tokens:
                    yield from _losses(known, tokens)
                    tokens = []
                current = part
                hashes, b, a, names, which, flags = _unpacked(block, TOKEN_TYPES)
                hashes = np.append(hashes, np.uint64(START))
                tokens.append((source, names, hashes[b], hashes[a], flags, which))
        if tokens:
            yield from _losses(known, tokens)

    return run


def _source_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, current = [], None

    def summed() -> pa.RecordBatch:
        rows, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
        names, owner = np.unique(rows, return_inverse=True)
        n, *losses = (np.bincount(owner, x, minlength=len(names)) for x in columns)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64)), *map(pa.array, losses)],
                                          names=["row", "n", "target", "background"])

    for batch in batches:
        for source, block in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if source != current and held:
                yield summed()
                held = []
            current = source
            held.append(_unpacked(block, SUM_TYPES))
    if held:
        yield summed()


def score_corpus(docs: DataFrame, is_target: str, text: str = "text") -> DataFrame:
    """The rows with ``n_tokens, target_loss, background_loss, difference`` in place of their text.

    The background model is counted on every text, the target model on those flagged (a null
    flag is no target); both share the vocabulary of all texts. Losses are means per token in
    nats, ``difference`` is target minus background, so lower is closer to the target. A
    flagged document is scored by a model that counts it too. Texts that are null or hold no
    word have 0 tokens and null losses. Existing columns of the four names are replaced,
    others stay whatever their names; whole texts are read; repeated rows are scored alike.
    Words and pairs are told apart by 64-bit hashes of words.
    """
    added = ("n_tokens", "target_loss", "background_loss", "difference")
    rows, spark = docs.drop(*added), docs.sparkSession
    kept = [c for c in rows.columns if c != text]
    handed = HandedOver(spark)
    staged = handed.write(rows.select(
        F.struct(*kept).alias("kept"), F.col(text).alias("text"),
        F.coalesce(F.col(is_target), F.lit(False)).alias("chosen"), F.monotonically_increasing_id().alias("row")))
    texts = staged.select("text", "chosen")
    both = [F.sum(c).alias(c) for c in ("target", "background")]
    words = handed.write(texts.mapInArrow(_word_counts(MEMO), "word long, target long, background long")
                         .groupBy("word").agg(*both))
    n, target, background = words.agg(F.count(F.lit(1)), F.sum("target"), F.sum("background")).first()
    totals = (target or 0, background or 0)
    # at most 2**HOT_BITS words, and the square of that in pairs
    frequent = words.filter(F.col("background") > totals[1] >> HOT_BITS).toArrow()
    handed.drop(words)
    hashes = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hot = hashes[order]
    counts = np.stack([frequent[c].to_numpy()[order] for c in ("target", "background")]).astype(np.int64)
    pairs = np.zeros((2, len(hot) ** 2), np.int64)
    if len(hot):
        found = (texts.mapInArrow(_hot_pairs(hot, MEMO), "pair long, target long, background long")
                 .groupBy("pair").agg(*both).toArrow())
        for m, c in enumerate(("target", "background")):
            pairs[m, found["pair"].to_numpy()] = found[c].to_numpy()
    shared = spark.sparkContext.broadcast(_Known(hot, counts, pairs, totals, max(1, n)))
    parts = max(1, -(-totals[1] // PART))
    blocks = staged.select("text", "chosen", "row").mapInArrow(_blocks(shared, parts, CHUNK, MEMO), BLOCK)
    back = blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_part_sums(shared), BLOCK)
    sums = handed.write(back.repartition("source").sortWithinPartitions("source").mapInArrow(
        _source_sums, "row long, n long, target double, background double"))
    target, background = (F.when(F.col("n") > 0, F.col(c) / F.col("n")) for c in ("target", "background"))
    scored = staged.select("row", "kept").join(sums, "row")
    return scored.select(
        *[F.col("kept").getField(c).alias(c) for c in kept], F.col("n").alias("n_tokens"),
        target.alias("target_loss"), background.alias("background_loss"), (target - background).alias("difference"))
