"""Alignment of two tokenizers over a corpus, and how often their tokens are linked.

Every map task encodes its documents with both tokenizers and cuts them where both have a
token end. The linked id pairs of its documents go into *runs*: about two million records
(pair, document, occurrences), radix-partitioned by the id of the second side, sorted by that
id, the first side's id and the document, and compressed with zstd. Counting merges the runs'
pair totals with a heap over their blocks, a bounded number of runs at a time. A merged
partition is in the order of the second side, so the largest count of each of its ids is at
hand once its last pair is there. The records are then streamed past the counts of their
partition, and what each document gains goes back to the task of its run.

Records of a token that holds a third of all links are spread over as many tasks as there are
groups of runs; what meets in one task are pair totals, of which there are never more than the
product of the two vocabularies.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimbook.llm.tables import slices, texts_of, written

PARTITIONS = 32
RECORDS = 2_000_000
DOCUMENTS = 8_192
FAN_IN = 64
RUNS_A_TASK = 32
CHUNK = 1 << 20
# characters of a generation of remembered units, each with 40 more
MEMO = 16_000_000
BLOCK = 8_192
DOC_BITS = 20

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = (*COUNTS, "n_best", "count_sum", "groups_sha256")

# A space after a character that is not white space: no token of either side reaches over it.
_UNIT = re.compile(r"(?<=\S)(?= )")


def _bytes_of_symbols() -> dict[str, int]:
    """Byte of every symbol of a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from 256 on in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and the alignment of each unit of text seen lately."""

    def __init__(self, byte_level: str, piece_model: str, memo: int = MEMO):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_file(byte_level)
        first.no_truncation()
        first.no_padding()
        first.encode_special_tokens = True
        second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.first, self.second, self.memo, self.older, self.recent, self.held = first, second, memo, {}, {}, 0
        self.n_first, self.n_second = first.get_vocab_size(with_added_tokens=True), second.get_piece_size()
        if self.n_first * self.n_second >> (63 - DOC_BITS):
            raise ValueError("the vocabularies leave no room for a document number")
        symbols, special = _bytes_of_symbols(), first.get_added_tokens_decoder()
        self.bytes_first = [
            b"" if i in special else bytes(symbols[c] for c in first.id_to_token(i)) for i in range(self.n_first)]
        pieces = [second.id_to_piece(i) for i in range(self.n_second)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that hold an inner space leave no proven boundary")
        self.bytes_second = [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)]
        self.width_first = np.array([len(x) for x in self.bytes_first])
        self.width_second = np.array([len(x) for x in self.bytes_second])
        self.shown = [f"{i}{mark}" for i in range(max(self.n_first, self.n_second)) for mark in (",", "|", ";", "\n")]

    def _align(self, units: list[str], first: list[list[int]], second: list[list[int]]) -> list[tuple | None]:
        """Token numbers, groups and linked pairs of units; None where a side loses bytes.

        The sides of all units stand in one row each; a byte offset at which both have an end
        is the end of a group, and of a unit if it is the unit's last.
        """
        whole = [
            u.encode() == b"".join([self.bytes_first[t] for t in a]) == b"".join([self.bytes_second[t] for t in b])
            for u, a, b in zip(units, first, second, strict=True)]
        first = [a for a, ok in zip(first, whole, strict=True) if ok]
        second = [b for b, ok in zip(second, whole, strict=True) if ok]
        n_a, n_b = [len(a) for a in first], [len(b) for b in second]
        a, b = np.array(list(chain(*first)), np.int64), np.array(list(chain(*second)), np.int64)
        ends_a, ends_b = np.cumsum(self.width_first[a]), np.cumsum(self.width_second[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        links = (b[last_b] * self.n_first + a[last_a]).tobytes()
        unit_end = np.cumsum(n_a) - 1
        closing = np.searchsorted(last_a, unit_end)
        # A's tokens of a group, then B's; the mark after a token tells what ends with it
        group = np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1])
        marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        marks_a[last_a], marks_b[last_b] = 1, 2
        marks_b[last_b[closing]] = 3
        ids, marks = np.concatenate([a, b]), np.concatenate([marks_a, marks_b])
        order = np.argsort(group, kind="stable")
        shown = "".join(map(self.shown.__getitem__, (4 * ids + marks)[order].tolist())).split("\n")
        stops = (8 * (closing + 1)).tolist()
        aligned = zip(n_a, n_b, shown, [0, *stops], stops, strict=False)
        found = iter([(x, y, text, links[lo:hi]) for x, y, text, lo, hi in aligned])
        return [next(found) if ok else None for ok in whole]

    def learn(self, units: list[str]) -> dict[str, tuple | None]:
        """The alignment of every distinct unit; those seen lately are not encoded again."""
        out, new = {}, []
        for unit in set(units):
            if unit in self.recent:
                out[unit] = self.recent[unit]
            elif unit in self.older:
                out[unit] = self.recent[unit] = self.older[unit]
            else:
                new.append(unit)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            first = self.first.encode_batch_fast(part, add_special_tokens=False)
            # the model adds the space that every unit begins with
            second = self.second.encode([u[1:] for u in part], num_threads=1)
            known = dict(zip(part, self._align(part, [e.ids for e in first], second), strict=True))
            out |= known
            self.recent |= known
            self.held += sum(map(len, part)) + 40 * len(part)
        if self.held > self.memo:
            self.older, self.recent, self.held = self.recent, {}, 0
        return out


def units_of(text: str) -> list[str]:
    """The units of a text that begins with a space; each begins with one."""
    units = _UNIT.split(text)
    if len(units) > 1 and units[-1] == " ":
        # the model adds no space to nothing
        units[-2:] = ["".join(units[-2:])]
    return units


def chunks_of(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end where a unit ends."""
    at = 0
    while len(text) - at > size:
        cut = _UNIT.search(text, at + size, len(text) - 1)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@dataclass
class _Document:
    """What is known of a document while its parts come in."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    whole: bool = True
    digest: object = None
    keys: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)

    def add(self, aligned: list[tuple | None]) -> None:
        if not self.whole or None in aligned:
            self.whole, self.keys, self.times = False, [], []
            return
        n_a, n_b, shown, links = zip(*aligned, strict=True)
        links = np.frombuffer(b"".join(links), np.int64)
        self.n_a += sum(n_a)
        self.n_b += sum(n_b)
        self.n_groups += len(links)
        text = ";".join(shown)
        if self.digest is None:
            self.digest = sha256(text.encode())
        else:
            self.digest.update(b";" + text.encode())
        key, n = np.unique(links, return_counts=True)
        self.keys.append(key)
        self.times.append(n)

    def row(self) -> tuple[int, int, int, int, str]:
        if not self.whole or self.digest is None:
            return 0, 0, 0, 0, ""
        # every group ends with one link, since no token is without bytes
        return self.n_a, self.n_b, self.n_groups, self.n_groups, self.digest.hexdigest()


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one zstd frame, bytes of like weight side by side."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of a frame, by their kinds."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(data) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _blocks(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys, totals = _unpack(blob, "<i8", "<i8")
    keys = np.cumsum(keys)
    for at in range(0, len(keys), BLOCK):
        yield keys[at : at + BLOCK], totals[at : at + BLOCK]


def merge(runs: Sequence[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rising pairs and their summed totals from runs of rising pairs.

    The heap holds the last pair of every run's block. All pairs up to the smallest of them are
    in memory, so they are summed and given out; runs whose block is used up bring their next.
    """
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def bring(i: int) -> None:
        block = next(runs[i], None)
        if block is None:
            heads.pop(i, None)
        else:
            heads[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        bring(i)
    while heap:
        bound = heap[0][0]
        taken, used = [], []
        for i, (keys, totals) in heads.items():
            n = int(np.searchsorted(keys, bound, "right"))
            if n:
                taken.append((keys[:n], totals[:n]))
                heads[i] = (keys[n:], totals[n:])
        while heap and heap[0][0] == bound:
            used.append(heapq.heappop(heap)[1])
        for i in used:
            bring(i)
        keys = np.concatenate([k for k, _ in taken])
        totals = np.concatenate([t for _, t in taken])
        order = np.argsort(keys, kind="stable")
        keys, totals = keys[order], totals[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        yield keys[first], np.add.reduceat(totals, first)


class _Run:
    """Documents and linked pairs that make up one run."""

    def __init__(self, number: int):
        self.number, self.docs, self.held = number, 0, 0
        self.entries: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, states: Sequence[_Document]) -> None:
        for at, state in enumerate(states):
            for key, n in zip(state.keys, state.times, strict=True):
                self.entries.append((key << DOC_BITS) | (self.docs + at))
                self.times.append(n)
                self.held += len(key)
        self.docs += len(states)

    def packed(self, partitions: int, n_first: int) -> dict[str, list]:
        """Per radix partition: pair totals, documents per pair, and the records."""
        out: dict[str, list] = {"bucket": [], "pairs": [], "spread": [], "records": []}
        if not self.entries:
            return out
        entry, n = np.concatenate(self.entries), np.concatenate(self.times)
        radix = ((entry >> DOC_BITS) // n_first) % partitions
        order = np.lexsort((entry, radix))
        radix, entry, n = radix[order], entry[order], n[order]
        pair_of, doc = entry >> DOC_BITS, entry & ((1 << DOC_BITS) - 1)
        edges = np.searchsorted(radix, np.arange(partitions + 1))
        for b, lo, hi in zip(range(partitions), edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            first = np.flatnonzero(np.diff(pair_of[lo:hi], prepend=-1))
            out["bucket"].append(b)
            out["pairs"].append(_pack(_deltas(pair_of[lo:hi][first]), np.add.reduceat(n[lo:hi], first)))
            out["spread"].append(_pack(np.diff(np.append(first, hi - lo)).astype("<i4")))
            out["records"].append(_pack(doc[lo:hi].astype("<i4"), n[lo:hi]))
        return out


def _encoded(texts: list[str], pair: Pair) -> list[_Document]:
    """The documents of some texts; long ones are encoded part by part."""
    states: list[_Document] = [_Document() for _ in texts]
    jobs: list[tuple[int, list[str]]] = []
    weight = 0

    def settle() -> None:
        known = pair.learn([u for _, units in jobs for u in units])
        for at, units in jobs:
            states[at].add([known[u] for u in units])
        jobs.clear()

    for at, text in enumerate(texts):
        for part in chunks_of(" " + text) if text else ():
            jobs.append((at, units_of(part)))
            weight += len(part)
            if weight >= CHUNK:
                settle()
                weight = 0
    settle()
    return states


@lru_cache(maxsize=2)
def _pair(byte_level: str, piece_model: str) -> Pair:
    return Pair(byte_level, piece_model)


def _written_runs(rows: DataFrame, text: str, byte_level: str, piece_model: str, partitions: int, records: int) -> DataFrame:
    """One table of document rows (``bucket`` null) and of the runs' partitions."""
    position = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if i != position]
    row_type = rows.drop(text).schema
    ddl = "run long, bucket int, n_docs int, pairs binary, spread binary, records binary, pos int"
    ddl += "".join(f", {c} long" for c in COUNTS) + ", groups_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_level, piece_model)
        run = _Run(TaskContext.get().partitionId() << 32)
        shape = None

        def filled(size: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns.get(f.name, pa.nulls(size, f.type)) for f in shape], schema=shape)

        def closed() -> pa.RecordBatch:
            packed = run.packed(partitions, pair.n_first)
            size = len(packed["bucket"])
            columns = {k: pa.array(v, shape.field(k).type) for k, v in packed.items()}
            columns["run"] = pa.array([run.number] * size, pa.int64())
            columns["n_docs"] = pa.array([run.docs] * size, pa.int32())
            return filled(size, columns)

        for batch in slices(batches, 512, 2 << 20):
            inner = [batch.schema.field(i) for i in kept]
            shape = shape or pa.schema([
                ("run", pa.int64()), ("bucket", pa.int32()), ("n_docs", pa.int32()), ("pairs", pa.binary()),
                ("spread", pa.binary()), ("records", pa.binary()), ("pos", pa.int32()),
                *[(c, pa.int64()) for c in COUNTS], ("groups_sha256", pa.string()), ("row", pa.struct(inner))])
            states = _encoded(texts_of(batch.column(position)), pair)
            said = [s.row() for s in states]
            columns = {c: pa.array([v[k] for v in said], pa.int64()) for k, c in enumerate(COUNTS)}
            columns |= {
                "run": pa.array([run.number] * len(said), pa.int64()),
                "pos": pa.array(range(run.docs, run.docs + len(said)), pa.int32()),
                "groups_sha256": pa.array([v[4] for v in said], pa.string()),
                "row": pa.StructArray.from_arrays([batch.column(i) for i in kept], fields=inner),
            }
            yield filled(len(said), columns)
            run.add(states)
            if run.held >= records or run.docs >= DOCUMENTS:
                yield closed()
                run = _Run(run.number + 1)
        if shape is not None:
            yield closed()

    schema = T.StructType([*T.StructType.fromDDL(ddl).fields, T.StructField("row", row_type)])
    return written(rows.mapInArrow(encode, schema))


def _counted(runs: DataFrame, n_first: int, fan_in: int) -> DataFrame:
    """Per radix partition the pairs, their counts, and whether a count is the highest of its id."""

    def merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        blocks = list(merge([_blocks(b) for b in rows["pairs"].to_pylist()]))
        return np.concatenate([k for k, _ in blocks]), np.concatenate([t for _, t in blocks])

    def combine(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, totals = merged(rows)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "run": pa.array([key[1].as_py()], pa.int64()),
                         "pairs": pa.array([_pack(_deltas(keys), totals)], pa.binary())})

    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, totals = merged(rows)
        # rising pairs hold the ids of the second side one after another
        side = keys // n_first
        first = np.flatnonzero(np.diff(side, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(totals, first), np.diff(np.append(first, len(side))))
        best = (totals == highest).astype("<i1")
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()),
                         "counts": pa.array([_pack(_deltas(keys), totals, best)], pa.binary())})

    left = runs.select("bucket", "run", "pairs")
    n_runs = runs.select("run").distinct().count()
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        group = F.pmod(F.xxhash64("run"), F.lit(n_runs))
        left = written(left.select("bucket", group.alias("run"), "pairs").groupBy("bucket", "run").applyInArrow(
            combine, "bucket int, run long, pairs binary"))
    return left.groupBy("bucket").applyInArrow(finish, "bucket int, counts binary")


def _contributions(runs: DataFrame, counts: DataFrame, tasks: int) -> DataFrame:
    """What every document of a run gains from a partition: best links and summed counts."""

    def stream(rows: pa.Table, counted: pa.Table) -> pa.Table:
        keys, totals, best = _unpack(counted["counts"][0].as_py(), "<i8", "<i8", "<i1")
        keys, out = np.cumsum(keys), []
        for i in range(rows.num_rows):
            pairs, _ = _unpack(rows["pairs"][i].as_py(), "<i8", "<i8")
            (spread,) = _unpack(rows["spread"][i].as_py(), "<i4")
            doc, n = _unpack(rows["records"][i].as_py(), "<i4", "<i8")
            at = np.repeat(np.searchsorted(keys, np.cumsum(pairs)), spread)
            gains = np.zeros((2, rows["n_docs"][i].as_py()), np.int64)
            np.add.at(gains[0], doc, n * best[at])
            np.add.at(gains[1], doc, n * totals[at])
            out.append(_pack(*gains))
        return pa.table({"run": rows["run"], "gains": pa.array(out, pa.binary())})

    dealt = runs.withColumn("task", F.pmod(F.xxhash64("run"), F.lit(tasks)).cast("int"))
    copies = counts.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return dealt.select("bucket", "task", "run", "n_docs", "pairs", "spread", "records").groupBy("bucket", "task").cogroup(
        copies.groupBy("bucket", "task")).applyInArrow(stream, "run long, gains binary")


def align(docs: DataFrame, byte_level: str, piece_model: str, text: str = "text", partitions: int = PARTITIONS,
          records: int = RECORDS, fan_in: int = FAN_IN, runs_a_task: int = RUNS_A_TASK) -> DataFrame:
    """The rows, less their text, with how the tokens of two tokenizers line up in it.

    Side A (``byte_level``, a byte-level file) encodes a space and the text, side B
    (``piece_model``) the text, to which it adds that space. Special strings in a text are plain
    text. Byte offsets at which both have a token end cut the tokens into ``n_groups`` groups;
    the A and B token that end there are a link. A pair of ids counts all its links in the
    corpus. ``n_best`` are a document's links whose count is the highest of their B id (ties
    included), ``count_sum`` is the sum of its links' counts, ``groups_sha256`` the digest of
    the groups' ids as text.

    Texts that are null or empty, or of which a side does not give the bytes back, have zeros
    and an empty digest, and count for no pair. Repeated rows each count. An empty table gives
    no rows. Existing columns with the names of the results are replaced, all others stay.
    """
    rows = docs.drop(*[c for c in RESULT if c != text])
    both = _written_runs(rows, text, byte_level, piece_model, partitions, records)
    runs = both.filter("bucket is not null")
    counts = written(_counted(runs, _pair(byte_level, piece_model).n_first, fan_in))
    n_runs = runs.select("run").distinct().count()
    gains = _contributions(runs, counts, max(1, -(-n_runs // runs_a_task)))

    def attach(rows: pa.Table, gained: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        pos = rows["pos"].to_numpy()
        sums = np.zeros((2, int(pos.max()) + 1 if len(pos) else 0), np.int64)
        for blob in gained["gains"].to_pylist():
            sums += _unpack(blob, "<i8", "<i8")
        return pa.table({
            "row": rows["row"], **{c: rows[c] for c in COUNTS}, "n_best": sums[0][pos], "count_sum": sums[1][pos],
            "groups_sha256": rows["groups_sha256"]})

    listed = both.filter("bucket is null").select("run", "pos", *COUNTS, "groups_sha256", "row")
    schema = T.StructType([
        T.StructField("row", rows.drop(text).schema),
        *T.StructType.fromDDL(", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in RESULT)).fields])
    joined = listed.groupBy("run").cogroup(gains.groupBy("run")).applyInArrow(attach, schema)
    return joined.select("row.*", *RESULT)
