"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question keeps its template when
it is given other numbers or names. Template windows are hash-joined; a run of matching
windows counts only if its slots are filled consistently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimbook.llm.tables import slices, texts_of, written

WINDOW = 8
LITERALS = 4
REQUIRED = 13
SHARE = 0.8
FILTER_BITS = 24
MEMO = 400_000

# Units that are replaced by a placeholder.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds "
    "ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh".split()
)
NUMBER = regex.compile(r"[\p{Sc}+-]?\d[\d.,:/]*%?")
EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$")
END = regex.compile(r"[.!?:;]['\")\]]*$")
LITERAL, NUMERAL, UNIT, NAME, OPENER = range(5)
SURFACE = np.uint64(0xA0761D6478BD642F)
PLACEHOLDERS = np.array([0, 11, 12, 13, 13], np.uint64)


class Vocabulary:
    """Codes of surface words with their literal hash, kind and whether they end a sentence."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.ends: list[bool] = []
        self.value: list[str] = []

    def add(self, word: str) -> int:
        bare = EDGE.sub("", word)
        low = bare.lower()
        if NUMBER.fullmatch(bare):
            kind = NUMERAL
        elif low in UNITS:
            kind = UNIT
        elif bare[:1].isupper() and bare[1:].islower():
            kind = NAME
        else:
            kind = LITERAL
        self.code[word] = at = len(self.hash)
        self.hash.append(xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 1) if low else 0)
        self.kind.append(kind)
        self.ends.append(bool(END.search(word)))
        self.value.append(low)
        return at

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word codes of all texts in a row, line starts, and each text's first word and the end.

        Tokens without a letter or digit are left out.
        """
        if len(self.hash) > MEMO:
            self.__init__()
        get, out, starts, first = self.code.get, [], [], [0]
        for text in texts:
            for line in text.split("\n"):
                starts.append(len(out))
                for word in line.split():
                    at = get(word)
                    out.append(self.add(word) if at is None else at)
            first.append(len(out))
        codes = np.array(out, np.int64)
        line = np.zeros(len(out) + 1, bool)
        line[starts] = True
        return codes, line[:-1], np.array(first)

    def templates(self, texts: list[str]):
        """Template hash, kind, word code, owning text and surface hash of every kept token.

        A title-case word that opens a sentence or line is an ``OPENER``; its hash is the literal one.
        """
        codes, line, first = self.codes(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        hashes, kinds = np.array(self.hash, np.uint64), np.array(self.kind, np.int64)
        ends = np.array(self.ends, bool)
        if not len(codes):
            return np.zeros(0, np.uint64), codes, codes, owner, np.zeros(0, np.uint64)
        opens = line.copy()
        opens[1:] |= ends[codes[:-1]]
        opens[0] = True
        kind = kinds[codes]
        kind = np.where((kind == NAME) & opens, OPENER, kind)
        token = np.where((kind == LITERAL) | (kind == OPENER), hashes[codes], PLACEHOLDERS[kind])
        kept = hashes[codes] != 0
        return token[kept], kind[kept], codes[kept], owner[kept], hashes[codes[kept]]


def windows(token: np.ndarray, kind: np.ndarray, owner: np.ndarray, width: int, least: int = LITERALS):
    """Start and hash of every window inside one text that holds ``least`` literal words, or no other if it is shorter."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ token[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    good = (owner[:n] == owner[width - 1 :]) & (literal[width:] - literal[:n] >= min(least, width))
    at = np.flatnonzero(good)
    return at, h[at]


SLOTS = "array<struct<kind:int,at:int,value:string>>"


def readings(token: np.ndarray, kind: np.ndarray, owner: np.ndarray, surface: np.ndarray, width: int, every: bool):
    """Start, hash and kinds of the windows by each reading.

    Openers are read as literal words, and as names where there are any. Windows of too few
    literal words for a template, or ``every`` one, are also read word by word with all
    values, unless they are bare numbers.
    """
    plain = np.where(kind == OPENER, LITERAL, kind)
    yield *windows(token, plain, owner, width), plain
    opener = kind == OPENER
    if opener.any() and len(token) >= width:
        at, h = windows(np.where(opener, PLACEHOLDERS[OPENER], token), kind, owner, width)
        n = np.concatenate([[0], np.cumsum(opener)])
        some = n[at + width] > n[at]
        yield at[some], h[some], kind
    if len(token) >= width:
        at, h = windows(surface ^ SURFACE, np.where(kind == NUMERAL, NUMERAL, LITERAL), owner, width, 1)
        if not every:
            n = np.concatenate([[0], np.cumsum(kind == LITERAL)])
            few = n[at + width] - n[at] < min(LITERALS, width)
            at, h = at[few], h[few]
        yield at, h, np.where((kind == NUMERAL) | (kind == UNIT), kind, LITERAL)  # whatever the case of the letters


def _rows(vocabulary, keys, at, h, width, token, kind, codes, owner):
    first = np.searchsorted(owner, np.arange(len(keys)))
    value = vocabulary.value
    slots = []
    for a in at.tolist():
        base = int(first[owner[a]])
        slots.append([
            {"kind": int(kind[i]), "at": i - base, "value": value[codes[i]]}
            for i in range(a, a + width) if kind[i] != LITERAL
        ])
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(owner[at])), pa.array(h.view(np.int64)), pa.array(at - first[owner[at]], pa.int64()),
            pa.array(slots, pa.list_(pa.struct([("kind", pa.int32()), ("at", pa.int32()), ("value", pa.string())]))),
        ],
        names=["key", "hash", "pos", "slots"],
    )


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in slices(batches, 512):
            keys, texts = batch.column(0), texts_of(batch.column(1))
            for i, text in enumerate(texts):
                token, kind, codes, owner, surface = vocabulary.templates([text])
                w = min(width, len(token))
                if not w:
                    continue
                for at, h, read in readings(token, kind, owner, surface, w, True):
                    out = _rows(vocabulary, keys.slice(i, 1), at, h, w, token, read, codes, owner)
                    n = out.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(np.full(n, w)), pa.array(np.full(n, len(token)))],
                        names=[*out.schema.names, "width", "words"],
                    )

    return run


def _document_windows(widths: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = Vocabulary(), shared.value
        for batch in slices(batches, 1024):
            keys = batch.column(0)
            texts = texts_of(batch.column(1))
            row = np.array([xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
            token, kind, codes, owner, surface = vocabulary.templates(texts)
            for w, (at, h, read) in ((w, found) for w in widths for found in readings(token, kind, owner, surface, w, False)):
                slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hit = (known[slot >> 3] >> (slot & 7)) & 1 > 0
                if hit.any():
                    out = _rows(vocabulary, keys, at[hit], h[hit], w, token, read, codes, owner)
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(row[owner[at[hit]]])], names=[*out.schema.names, "row"])

    return run


def _stretch(tokens: list[int], slots: dict[int, tuple[int, str, str]]) -> tuple[int, int, int] | None:
    """Begin, end and literal tokens of the longest part of a run whose slots are filled consistently.

    A value of the item stands for one value throughout; a name or unit of the document
    also stands for one of the item, while two numbers may become the same.
    """
    maps: dict[tuple, dict[str, int]] = {}
    clashes = begin = literal = 0
    best = None

    def count(at: int, by: int) -> int:
        kind, asked, found = slots[at]
        change = 0
        for side, one, other in ((0, asked, found), (1, found, asked)):
            if side and kind == NUMERAL:
                continue
            seen = maps.setdefault((side, kind, one), {})
            before = len(seen) > 1
            seen[other] = seen.get(other, 0) + by
            if not seen[other]:
                del seen[other]
            change += (len(seen) > 1) - before
        return change

    for end, at in enumerate(tokens):
        if at in slots:
            clashes += count(at, 1)
        else:
            literal += 1
        while clashes:
            gone = tokens[begin]
            if gone in slots:
                clashes += count(gone, -1)
            else:
                literal -= 1
            begin += 1
        whole = end + 1 - begin == len(tokens)
        if (whole or literal >= REQUIRED) and (best is None or end + 1 - begin > best[1] - best[0]):
            best = begin, end + 1, literal
    return best


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            slots = {p["at"]: (min(p["kind"], NAME), p["asked"], p["found"]) for p in r["pairs"]
                     if p["kind"] != OPENER or p["asked"] != p["found"]}
            best = _stretch(r["tokens"], slots)
            if best:
                held = r["tokens"][best[0] : best[1]]
                filled = [slots[t] for t in held if t in slots]
                out.append((r["key"], r["item"], r["shift"], r["words"], len(held), len(filled),
                            any(asked != found for _, asked, found in filled)))
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.bool_())],
            names=["key", "item", "shift", "n_words", "n_matched", "n_slots", "reworded"])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """Documents that hold a benchmark item, one row per document and item.

    ``key, item, n_matched, n_words, n_slots, reworded``: tokens of the item found in one
    aligned run, tokens of the item, slots in that run, and whether a slot holds another
    value than in the item. A document is reported if an aligned run matches ``REQUIRED``
    tokens, or 80 % of a shorter item, and no slot value of the item stands for two values
    of the document, no name or unit of the document for two of the item. A run that breaks
    this is reported by its longest consistent stretch, if that holds ``REQUIRED`` literal
    tokens; the counts are those of the stretch.

    Tokens are words between white space without the marks around them, in lower case;
    words without letter or digit do not count. A name is a word in title case; one that
    opens a sentence or line is read both as a name and as a literal word. Windows have ``width`` tokens (the whole item, if it is
    shorter) with at least four literal ones; those with fewer match with the same values
    only, and rows of bare numbers never. An item of fewer than 8 tokens must match whole. Executors drop windows by a bit table of fixed
    size before the join, which any number of items leaves at 2 MB.

    Null and empty texts on either side match nothing. Rows that share a key are read one
    by one and reported together; null keys are not reported. An empty table gives no rows.
    """
    spark = docs.sparkSession
    items = written(benchmark.filter(F.col(item).isNotNull()).select(F.col(item).alias("key"), F.col(item_text).alias("text"))
                    .mapInArrow(_item_windows(width),
                                "key long, hash long, pos long, slots " + SLOTS + ", width long, words long"))
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = items.select(slot.alias("slot")).distinct().toArrow()  # at most 2**24 numbers
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    at = bits["slot"].to_numpy()
    np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    found = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        _document_windows(widths, spark.sparkContext.broadcast(table)),
        "key long, hash long, pos long, slots " + SLOTS + ", row long")
    right = items.select(
        F.col("key").alias("item"), "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "width", "words")
    matched = found.join(right, "hash").select(
        "key", "row", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "width", "words",
        F.arrays_zip("slots", "item_slots").alias("pairs"))
    run = ["key", "row", "item", "shift"]
    cover = matched.groupBy(*run).agg(
        F.max("words").alias("words"),
        F.collect_set(F.struct("item_pos", "width")).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    tokens = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["item_pos"], a["item_pos"] + a["width"] - 1))))
    pairs = F.transform("pairs", lambda p: F.struct(
        p["item_slots"]["at"].alias("at"), F.greatest(p["slots"]["kind"], p["item_slots"]["kind"]).alias("kind"), p["item_slots"]["value"].alias("asked"),
        p["slots"]["value"].alias("found")))
    required = F.when(F.col("words") < WINDOW, F.col("words")).otherwise(
        F.least(F.lit(REQUIRED), F.ceil(SHARE * F.col("words"))))
    rows = cover.select("key", "item", "shift", "words", F.sort_array(tokens).alias("tokens"), pairs.alias("pairs")).filter(
        F.size("tokens") >= required).mapInArrow(
        _judged, "key long, item long, shift long, n_words long, n_matched long, n_slots long, reworded boolean")
    best = Window.partitionBy("key", "item").orderBy(F.col("n_matched").desc(), "reworded", "shift")
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(
        F.col("key").alias(key), F.col("item").alias(item), "n_matched", "n_words", "n_slots", "reworded")
