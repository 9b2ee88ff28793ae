"""Token counts of whole texts, huge documents included, by overlap resynchronisation.

A chunk of a document is encoded on its own and reports where its *units* start and
how many tokens each holds. A unit starts at a space that follows a character which is
not white space. The byte-level pre-tokenizer never joins such a pair of characters in
one piece, its choices after that space depend on nothing before it, and no special
string holds a space, so every unit start is a token boundary of the whole text: it is
proven stable. Two chunks that share a unit start can be spliced there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimbook.llm.tables import plus, slices, texts_of

CHUNK = 1 << 16
OVERLAP = 1 << 9
MEMO = 500_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if any(" " in t.content or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("special strings with spaces leave no proven boundary")
    return tokenizer


class Units:
    """Token counts of units; each distinct unit is encoded once while it is remembered."""

    def __init__(self, path: str, memo: int = MEMO):
        self.tokenizer, self.memo, self.known = _tokenizer(path), memo, {}

    def split(self, text: str) -> list[str]:
        """The units of a text, in order; joined they are the text."""
        units: list[str] = []
        for i, part in enumerate(text.split(" ")):
            if i == 0:
                units.append(part)
            elif units[-1] and not units[-1][-1].isspace():
                units.append(" " + part)
            else:
                units[-1] += " " + part
        return units

    def counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit."""
        known = self.known
        new = list({u for u in units if u not in known})
        if new:
            if len(known) + len(new) > self.memo:
                known.clear()
                new = list(set(units))
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                for unit, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    known[unit] = len(e.ids)
        return np.fromiter((known[u] for u in units), np.int64, len(units))

    def encode(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """Start of every unit of a chunk, and the tokens before each start and in all."""
        units = self.split(chunk)
        starts = np.zeros(len(units) + 1, np.int64)
        np.cumsum([len(u) for u in units], out=starts[1:])
        before = np.zeros(len(units) + 1, np.int64)
        np.cumsum(self.counts(units), out=before[1:])
        return starts[:-1], before

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a whole text.

        Texts longer than ``chunk`` characters are encoded in chunks that overlap by
        ``overlap``. Neighbours are spliced at their first common stable boundary; where
        an overlap holds none, the left chunk grows by twice the overlap until it does or
        the text ends.
        """
        if len(text) <= chunk:
            return int(self.encode(text)[1][-1])
        total, at = 0, 0
        starts, before = self.encode(text[: chunk + overlap])
        skipped = 0
        while True:
            end = at + chunk + overlap
            if end >= len(text):
                return total + int(before[-1]) - skipped
            width, nxt = overlap, at + chunk
            right_starts, right_before = self.encode(text[nxt : nxt + chunk + overlap])
            while True:
                common = np.intersect1d(starts[starts > chunk] + at, right_starts[right_starts > 0] + nxt)
                if len(common) or end >= len(text):
                    break
                width *= 2
                end = min(len(text), nxt + width)
                starts, before = self.encode(text[at:end])
                if width > chunk:
                    right_starts, right_before = self.encode(text[nxt : end + chunk])
            if not len(common):
                return total + int(before[-1]) - skipped
            cut = int(common[0])
            total += int(before[np.searchsorted(starts, cut - at)]) - skipped
            if width > chunk:
                # the boundary lies beyond the next chunk: start again exactly there
                at, skipped = cut, 0
                starts, before = self.encode(text[at : at + chunk + overlap])
            else:
                skipped = int(right_before[np.searchsorted(right_starts, cut - nxt)])
                at, starts, before = nxt, right_starts, right_before


@lru_cache(maxsize=2)
def _units(path: str) -> Units:
    return Units(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows with ``n_bytes``, ``n_tokens`` and ``over_limit``; the text column is dropped.

    ``path`` names a byte-level tokenizer file that the executors can read. Null texts count
    as empty: 0 bytes, 0 tokens. Existing columns of the three names are replaced. Repeated
    rows are each counted; tokens are those the library gives for the whole text.
    """
    rows = docs.drop("n_bytes", "n_tokens", "over_limit")
    position = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if i != position]
    schema = rows.drop(text).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(path)
        for batch in slices(batches, 1024):
            texts = texts_of(batch.column(position))
            n = [units.count(t, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in kept],
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                ],
                names=[*[batch.schema.names[i] for i in kept], "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, plus(schema, "n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
