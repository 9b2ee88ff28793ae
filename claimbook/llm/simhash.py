"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: two blocks of 23 bits, each in the binary Golay
code, which is perfect with covering radius 3. A fingerprint's home is the anchor whose
blocks are the nearest codewords (at most 3 bits off in each). A fingerprint within t bits
of it differs from it by i bits in the first block and j in the second, i + j <= t, so that
home lies within 3 + i and 3 + j of its own blocks. Each fingerprint is therefore replicated
to every anchor within those distances and compared with the homes there: no link is lost,
no limit is set on what an anchor holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimbook.llm.components import smallest_reachable
from claimbook.llm.tables import plus, slices, texts_of, written

SEED = 42
BLOCK = 23
RADIUS = 3
GENERATOR = 0b101011100011  # of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * n > len(hashes) else "0" for n in ones), 2)


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 of every word shingle; 0 where there is no word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        begin = [0, *ends[: len(parts) - words].tolist()]
        stop = (ends[words - 1 :] - 1).tolist()
        hashes = np.fromiter(
            (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, stop, strict=True)), np.uint64, len(begin)
        )
    return majority(hashes)


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """The rows with ``fp`` (the fingerprint's 64 bits as a long) in place of their text."""
    rows = docs.drop("fp")
    position = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if i != position]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found = np.array([fingerprint(t, words) for t in texts_of(batch.column(position))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(found.view(np.int64))],
                names=[*[batch.schema.names[i] for i in kept], "fp"],
            )

    return rows.mapInArrow(run, plus(rows.drop(text).schema, "fp long"))


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator: 0 for codewords."""
    x = x.copy()
    for bit in range(BLOCK - 1, 10, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - 11), 0)
    return x


@lru_cache(maxsize=1)
def _errors() -> list[tuple[np.ndarray, np.ndarray]]:
    """Per weight limit 3, 4 and 5: error patterns ordered by syndrome, and where each syndrome starts."""
    out = []
    for limit in range(RADIUS, RADIUS + 3):
        patterns = np.array(
            [sum(1 << b for b in c) for w in range(limit + 1) for c in combinations(range(BLOCK), w)], np.int64
        )
        s = _syndromes(patterns)
        order = np.argsort(s, kind="stable")
        out.append((patterns[order], np.searchsorted(s[order], np.arange(2049))))
    return out


def _near(block: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codewords: every codeword within 3 + extra of each word."""
    patterns, starts = _errors()[extra]
    s = _syndromes(block)
    n = starts[s + 1] - starts[s]
    row = np.repeat(np.arange(len(block)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, block[row] ^ patterns[starts[s][row] + inner]


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and anchors each fingerprint is replicated to."""
    low, high = fp & 0x7FFFFF, (fp >> BLOCK) & 0x7FFFFF
    rows, found = [], []
    for i in range(threshold + 1):
        r, a = _near(low, i)
        r2, b = _near(high[r], threshold - i)
        rows.append(r[r2])
        found.append(a[r2] | (b << BLOCK))
    both = np.unique(np.stack([np.concatenate(rows), np.concatenate(found)]), axis=1)
    return both[0], both[1]


def _replicas(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy().astype(np.int64)
                row, anchor = anchors(fp, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], names=["anchor", "fp"])

    return run


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().astype(np.int64)
        low, high = fp & 0x7FFFFF, (fp >> BLOCK) & 0x7FFFFF
        home = _near(low, 0)[1] | (_near(high, 0)[1] << BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(fp)], names=["anchor", "home"])


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints in ``fp`` that differ in at most ``threshold`` bits (0 to 2)."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover differences of up to 2 bits")
    homes = distinct.mapInArrow(_homes, "anchor long, home long")
    copies = distinct.mapInArrow(_replicas(threshold), "anchor long, fp long")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= threshold
    return (
        copies.join(homes, (copies["anchor"] == homes["anchor"]) & (F.col("fp") > F.col("home")) & close)
        .select(F.col("home").alias("a"), F.col("fp").alias("b"))
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3,
                    threshold: int = 2) -> DataFrame:
    """``key, fingerprint, component_id`` of every row.

    Fingerprints that differ in at most ``threshold`` bits are linked; ``component_id`` is
    the smallest key reachable over links, its own included. Texts that are null or hold no
    word have fingerprint zero and are linked like any other. Copies meet as one
    fingerprint, so a group of any size costs one vertex. Rows with a null key take part
    but are no component's name unless all its keys are null. Repeated rows repeat. Other
    columns do not matter; an empty table gives no rows.
    """
    marked = written(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", words))
    vertices = written(marked.groupBy("fp").agg(F.min("key").alias("first")))
    labels = smallest_reachable(links(vertices.select("fp"), threshold), vertices, "fp", "first")
    return marked.join(labels, "fp", "left").select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("label").alias("component_id"),
    )
