"""Sampled segmentations without replacement by Gumbel top-k search over the piece lattice, and decoding.

A text's lattice holds every way to cut it into pieces of a SentencePiece vocabulary. The
search tree's nodes are sets of segmentations that share a beginning; a set's perturbed
score is the maximum of its members' log-probability plus Gumbel noise. Children are drawn
top down, conditioned on their parent's maximum, and the best open set is expanded first:
A* whose bound is exact, so the first k leaves are the top k perturbed segmentations, a
sample without replacement.

No piece crosses the start of a *unit* (a space mark after another character). A set is
opened unit by unit: it yields its best member by sampling forward with the exact lattice
masses, and leaves behind, for each unit, the set of segmentations that agree before the
unit and differ in it. Sets are kept by their mass and maximum only and expanded when
they become the best.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from claimbook.llm.tables import plus, slices, texts_of

MARK = "▁"
MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ALL = (1 << 64) - 1
SPREAD = 22
ROWS, BYTES = 2_048, 1 << 20
ADDED = ("sample", "ids", "log_p", "perturbed", "inclusion", "round_trip")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a model file with log-probabilities and a lookup of substrings by hash.

    A BPE file stores merge ranks instead of probabilities; ranks follow frequency, so piece
    of rank r gets the Zipf weight 1 / (r + 2.7). The file of a unigram model has
    log-probabilities, which are taken as they are.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size)
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece crosses a space: units are not independent")
        scores = np.array([model.get_score(i) for i in normal])
        ranked = len(scores) > 1 and np.all(scores == np.round(scores))
        self.log_p = np.full(size, -np.inf)
        if ranked:
            order = np.empty(len(normal))
            order[np.argsort(-scores, kind="stable")] = np.arange(len(normal))
            weight = 1.0 / (order + 2.7)
            self.log_p[normal] = np.log(weight / weight.sum())
        else:
            self.log_p[normal] = scores
        self.byte = np.full(256, -1)
        for i in range(size):
            if model.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
        self.log_byte = float(self.log_p[normal].min())
        self.size, self.unknown = size, model.unk_id()
        self.longest = max(len(pieces[i]) for i in normal)
        self.bytes_of = [pieces[i].replace(MARK, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte):
            if i >= 0:
                self.bytes_of[i] = bytes([b])
        by_hash = sorted((self._hash(pieces[i]), i) for i in normal)
        self.keys = np.array([h for h, _ in by_hash], np.uint64)
        self.ids = np.array([i for _, i in by_hash], np.int32)
        spot = (self.keys >> np.uint64(64 - SPREAD)).astype(np.int64)
        self.maybe = np.zeros(1 << SPREAD, bool)
        self.maybe[spot] = True
        self.spot = np.zeros(1 << SPREAD, np.int32)
        self.spot[spot[::-1]] = np.arange(len(spot) - 1, -1, -1)  # the first key of a spot
        self.most = int(np.bincount(spot).max())

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the substring hashes are pieces, and their ids."""
        spot = (h >> np.uint64(64 - SPREAD)).astype(np.int32)
        maybe = np.flatnonzero(self.maybe[spot])
        key = self.spot[spot[maybe]]
        wanted = h[maybe]
        for _ in range(self.most - 1):  # keys that share a spot are neighbours
            key += (self.keys[key] != wanted) & (key + 1 < len(self.keys))
        true = np.flatnonzero(self.keys[key] == wanted)
        return maybe[true], self.ids[key[true]]

    def log_piece(self, piece: np.ndarray) -> np.ndarray:
        """Log-probability of edges: of a piece, or of a character spelled in bytes."""
        code = piece - self.size
        if len(code) and code[0] >= 0:
            return self.log_byte * (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        return self.log_p[piece]

    @staticmethod
    def _hash(piece: str) -> int:
        c = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(1, np.uint64)
        for x in c:
            h = _step(h, x)
        return int(h[0])

    def units(self, text: str) -> list[str]:
        """The normalised text cut where no piece can cross."""
        head, *parts = self.model.normalize(text).split(MARK)
        if "" not in parts:
            out = [MARK + part for part in parts]
            return [head, *out] if head else out
        out = [head]
        for part in parts:
            if out[-1] and out[-1][-1] != MARK:
                out.append(MARK + part)
            else:
                out[-1] += MARK + part
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of piece ids, the leading dummy space taken off."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def _step(h: np.ndarray, c) -> np.ndarray:
    h = (h ^ (c + MIX_B)) * MIX_A
    return h ^ (h >> np.uint64(32))


def _mixed_int(x: int) -> int:
    x &= ALL
    x = ((x ^ (x >> 30)) * int(MIX_B)) & ALL
    x = ((x ^ (x >> 27)) * int(MIX_C)) & ALL
    return x ^ (x >> 31)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Edges of many units at once, with the log-mass from each position to its unit's end."""

    def __init__(self, vocab: Vocabulary, units: list[str]):
        chars = "".join(units)
        c = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(lengths)
        self.start = ends - lengths
        n = len(c)
        rest = np.repeat(ends, lengths) - np.arange(n)
        h = np.zeros(n, np.uint64)
        found = []
        at = np.arange(n)
        single = np.zeros(n, bool)
        for width in range(1, vocab.longest + 1):
            if width > 1:
                fits = np.flatnonzero(rest[at] >= width)
                at, h = at[fits], h[fits]
            if not len(at):
                break
            h = _step(h, c[at + width - 1])
            hit, piece = vocab.lookup(h)
            found.append((width, at[hit], piece))
            if width == 1:
                single[found[0][1]] = True
        del at, h
        bare = np.flatnonzero(~single)
        found.append((1, bare, (vocab.size + c[bare].astype(np.int64)).astype(np.int32)))
        degree = sum((np.bincount(src, minlength=n) for _, src, _ in found), np.zeros(n, np.int64))
        self.first = np.concatenate([[0], np.cumsum(degree)])
        total = int(self.first[-1])
        self.piece, self.end = np.empty(total, np.int32), np.empty(total, np.int32)
        weight, free = np.empty(total), self.first[:-1].copy()
        found.sort(key=lambda x: x[0])
        while found:  # long pieces first
            width, src, piece = found.pop()
            place = free[src]
            self.piece[place] = piece
            self.end[place] = np.where(rest[src] == width, n, src + width)  # n is the sink
            weight[place] = vocab.log_piece(piece)
            free[src] += 1
        # from the ends of the units backwards: all positions at one distance at once
        self.mass = np.zeros(n + 1)
        self.log_edge, self.ladder = np.empty(total), np.empty(total)
        far = rest.astype(np.uint16) if n and rest.max() < 1 << 16 else rest
        by = np.argsort(far, kind="stable")
        cuts = np.searchsorted(far[by], np.arange(1, (int(far.max()) if n else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            node = by[a:b]
            count = degree[node]
            edge = _ragged(self.first[node], count)
            new = np.cumsum(count) - count
            value = weight[edge] + self.mass[self.end[edge]]
            top = np.maximum.reduceat(value, new)
            p = np.exp(value - np.repeat(top, count))
            run = np.cumsum(p)
            before = run[new] - p[new]
            span = run[new + count - 1] - before
            self.mass[node] = top + np.log(span)
            self.log_edge[edge] = value - np.repeat(self.mass[node], count)
            self.ladder[edge] = (run - np.repeat(before, count)) / np.repeat(span, count)
        self.ladder[self.first[1:] - 1] = 2.0

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node by its conditional probability."""
        e = self.first[node]
        more = np.flatnonzero(u >= self.ladder[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= self.ladder[e[more]]]
        return e

    def alternative(self, unit_start: int, taken: list[list[int]], draw) -> list[int]:
        """A path through one unit drawn from the mass that the taken paths leave."""
        sink, node, path = len(self.mass) - 1, unit_start, []
        live = []
        for x in taken:
            tail, total = [], 0.0
            for log_p in reversed(self.log_edge[x].tolist()):
                total += log_p
                tail.append(math.exp(total))
            live.append((x, tail[::-1]))
        while node != sink:
            a, b, depth = int(self.first[node]), int(self.first[node + 1]), len(path)
            w = [math.exp(v) for v in self.log_edge[a:b].tolist()]
            for x, tail in live:
                w[x[depth] - a] -= tail[depth]
            w = [max(v, 0.0) for v in w]
            left = draw(depth) * sum(w)
            e = max(range(b - a), key=w.__getitem__)
            for i, v in enumerate(w):
                left -= v
                if v > 0.0 and left < 0.0:
                    e = i
                    break
            live = [x for x in live if x[0][depth] == a + e]
            path.append(a + e)
            node = int(self.end[a + e])
        return path


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every part in a row."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


class Search:
    """Top-k perturbed segmentations of a batch of texts, one sample of each text a round."""

    def __init__(self, vocab: Vocabulary, texts: list[str], seeds: np.ndarray):
        seen: dict[str, int] = defaultdict(itertools.count().__next__)
        code, count = [], []
        for text in texts:
            units = vocab.units(text)
            count.append(len(units))
            code.extend(map(seen.__getitem__, units))
        word, units = np.array(code, np.int32), list(seen)
        del code, seen
        self.vocab, self.lattice = vocab, Lattice(vocab, units)
        self.count = np.array(count, np.int64)
        self.base = np.cumsum(self.count) - self.count
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        self.index = (np.arange(len(word)) - self.base[self.owner]).astype(np.uint64)
        self.node = self.lattice.start[word]
        self.seeds = seeds
        self.samples: list[dict] = []
        self.taken: dict[tuple[int, int], list[list[int]]] = {}

    def draw(self, words: np.ndarray, stream: int) -> np.ndarray:
        """Numbers in (0, 1) that depend on the text's seed, the unit's place and the stream alone."""
        x = _mixed(self.seeds[self.owner[words]] + self.index[words] * MIX_A)
        x = _mixed(x + np.uint64(((stream + 1) * int(MIX_C)) & ALL))
        return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)

    def draw_one(self, word: int, stream: int) -> float:
        """The same number for one unit."""
        x = _mixed_int(int(self.seeds[self.owner[word]]) + int(self.index[word]) * int(MIX_A))
        x = _mixed_int(x + (stream + 1) * int(MIX_C))
        return ((x >> 12) + 0.5) / float(1 << 52)

    def forward(self, words: np.ndarray, stream: int):
        """Edges of a fresh path through each unit, their counts, and the paths' log-probabilities."""
        lattice, sink = self.lattice, len(self.lattice.mass) - 1
        log_p, steps = np.zeros(len(words)), np.zeros(len(words), np.int64)
        live, node, parts, step = np.arange(len(words)), self.node[words], [], 0
        while len(live):
            e = lattice.pick(node, self.draw(words[live], (stream << 20) + step))
            parts.append((live, e))
            log_p[live] += lattice.log_edge[e]
            steps[live] += 1
            node = lattice.end[e]
            open_ = node != sink
            live, node = live[open_], node[open_]
            step += 1
        start = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), np.int32)
        for step, (who, e) in enumerate(parts):
            edges[start[who] + step] = e
        return edges, steps, log_p

    def leave(self, sample: dict, words: np.ndarray, top: np.ndarray, stream: int) -> None:
        """Maxima of the sets that differ from a sample first in each of the given units."""
        log_p = sample["log_p"]
        prefix = np.cumsum(log_p) - log_p
        prefix -= np.repeat(prefix[np.minimum(self.base, max(0, len(prefix) - 1))] if len(prefix) else
                            np.zeros(len(self.base)), self.count)
        sample["prefix"] = prefix
        with np.errstate(divide="ignore"):
            rest = np.log(-np.expm1(np.minimum(log_p[words], 0.0)))
        rest[log_p[words] > -1e-12] = -np.inf
        sample["open"] = np.full(len(log_p), -np.inf)
        sample["open"][words] = self.truncated(prefix[words] + rest, top[self.owner[words]], words, stream)

    def truncated(self, location, top, words, stream) -> np.ndarray:
        """Gumbel variables at a location, conditioned to lie below ``top``."""
        noise = -np.log(self.draw(words, (stream << 20) + (1 << 19)))
        with np.errstate(over="ignore"):
            g = location - np.log(np.exp(np.minimum(location - top, 700.0)) + noise)
        return np.minimum(g, top)

    def best(self):
        """The best open set of each text: its sample, unit and maximum."""
        value = np.full(len(self.count), -np.inf)
        sample = np.zeros(len(self.count), np.int64)
        word = np.zeros(len(self.count), np.int64)
        full = np.flatnonzero(self.count)
        for s, x in enumerate(self.samples):
            if not len(full):
                break
            top = np.maximum.reduceat(x["open"], self.base[full])
            better = top > value[full]
            if not better.any():
                continue
            spots = np.flatnonzero(x["open"] == np.repeat(top, self.count[full]))
            first = np.full(len(self.count), -1)
            first[self.owner[spots[::-1]]] = spots[::-1]
            value[full[better]] = top[better]
            sample[full[better]] = s
            word[full[better]] = first[full[better]]
        return sample, word, value

    def run(self, k: int):
        """Samples of every text in falling order of their perturbed scores."""
        texts = np.arange(len(self.count))
        everything = np.arange(len(self.owner))
        x = _mixed(_mixed(self.seeds + MIX_B) + MIX_C)
        top = -np.log(-np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)))
        edges, steps, log_p = self.forward(everything, 0)
        first = {"edges": edges, "steps": steps, "log_p": log_p, "top": top, "has": np.ones(len(texts), bool)}
        self.samples.append(first)
        self.leave(first, everything, top, 0)
        for stream in range(1, k):
            parent, word, value = self.best()
            has = np.isfinite(value)
            fresh = everything[has[self.owner] & (everything > word[self.owner])]
            new_edges, new_steps, new_log_p = self.forward(fresh, stream)
            steps, log_p = np.zeros(len(self.owner), np.int64), np.zeros(len(self.owner))
            steps[fresh], log_p[fresh] = new_steps, new_log_p
            swapped = {}
            for t in np.flatnonzero(has).tolist():
                s, w = int(parent[t]), int(word[t])
                old = self.samples[s]
                at = old["offset"] if "offset" in old else old.setdefault("offset", np.cumsum(old["steps"]) - old["steps"])
                taken = self.taken.setdefault((s, w), [old["edges"][at[w] : at[w] + old["steps"][w]].tolist()])
                path = self.lattice.alternative(
                    int(self.node[w]), taken,
                    lambda d, w=w, stream=stream: self.draw_one(w, (stream << 20) + (1 << 18) + d))
                taken.append(path)
                swapped[w] = path
                steps[w], log_p[w] = len(path), sum(self.lattice.log_edge[path].tolist())
                left = 1.0 - sum(math.exp(sum(self.lattice.log_edge[x].tolist())) for x in taken)
                if left > 1e-12:
                    location, top = float(old["prefix"][w]) + math.log(left), float(value[t])
                    noise = -math.log(self.draw_one(w, (stream << 20) + (1 << 19) + 1))
                    old["open"][w] = min(top, location - math.log(math.exp(min(location - top, 700.0)) + noise))
                else:
                    old["open"][w] = -np.inf
            kept = has[self.owner] & (everything < word[self.owner])
            for s, old in enumerate(self.samples):
                mine = everything[kept & (parent[self.owner] == s)]
                steps[mine], log_p[mine] = old["steps"][mine], old["log_p"][mine]
            start = np.cumsum(steps) - steps
            edges = np.empty(int(steps.sum()), np.int32)
            edges[_ragged(start[fresh], steps[fresh])] = new_edges
            for s, old in enumerate(self.samples):
                mine = everything[kept & (parent[self.owner] == s)]
                at = np.cumsum(old["steps"]) - old["steps"]
                edges[_ragged(start[mine], steps[mine])] = old["edges"][_ragged(at[mine], steps[mine])]
            for w, path in swapped.items():
                edges[start[w] : start[w] + len(path)] = path
            sample = {"edges": edges, "steps": steps, "log_p": log_p, "top": value, "has": has}
            self.leave(sample, fresh, value, stream)
            self.samples.append(sample)
        kappa = self.best()[2]
        return self.samples, kappa

    def pieces(self, sample: dict) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a sample of every text in a row, and how many each text has."""
        ids = self.lattice.piece[sample["edges"]].astype(np.int32)
        owner = np.repeat(self.owner, sample["steps"])
        bare = np.flatnonzero(ids >= self.vocab.size)
        if len(bare):
            width = np.ones(len(ids), np.int64)
            spelled = [chr(int(ids[i]) - self.vocab.size).encode("utf-8", "surrogatepass") for i in bare]
            width[bare] = [len(b) for b in spelled]
            ids, owner = np.repeat(ids, width), np.repeat(owner, width)
            at = _ragged((np.cumsum(width) - width)[bare], width[bare])
            found = self.vocab.byte[np.frombuffer(b"".join(spelled), np.uint8)]
            ids[at] = np.where(found >= 0, found, self.vocab.unknown)
        return ids, np.bincount(owner, minlength=len(self.count))


def _sampled(vocab: Vocabulary, batch: pa.RecordBatch, position: int, key_at: int, k: int,
             seed: int) -> Iterator[pa.RecordBatch]:
    """The samples of one slice; what it holds is freed before the next slice is begun."""
    texts = texts_of(batch.column(position))
    names = ["null" if x is None else str(x) for x in batch.column(key_at).to_pylist()]
    seeds = np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in names], np.uint64)
    search = Search(vocab, texts, seeds)
    samples, kappa = search.run(k)
    kept = [i for i in range(batch.num_columns) if i != position]
    for number, sample in enumerate(samples, 1):
        ids, count = search.pieces(sample)
        has = np.flatnonzero(sample["has"])
        ends = np.concatenate([[0], np.cumsum(count)])
        same = [vocab.decode(ids[ends[t] : ends[t + 1]].tolist()) == texts[t].replace(MARK, " ") for t in has.tolist()]
        log_p = np.bincount(search.owner, sample["log_p"], minlength=len(count)).astype(np.float64)
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(log_p - kappa))
        picked = batch.take(pa.array(has))
        # texts without this sample hold no ids, so the offsets of the others still fit
        spans = np.concatenate([ends[:-1][has], ends[-1:]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                *[picked.column(i) for i in kept],
                pa.array(np.full(len(has), number, np.int32)),
                pa.ListArray.from_arrays(pa.array(spans), pa.array(ids)),
                pa.array(log_p[has]), pa.array(sample["top"][has]), pa.array(inclusion[has]),
                pa.array(same, pa.bool_()),
            ],
            names=[*[batch.schema.names[i] for i in kept], *ADDED],
        )


def sample_segmentations(docs: DataFrame, path: str, k: int = 2, seed: int = 11, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """Up to ``k`` distinct segmentations of every text, in place of the text.

    Each row comes back once per sample with ``sample`` (from 1, falling perturbed score),
    ``ids``, ``log_p`` (natural log-probability of the segmentation), ``perturbed`` (with its
    Gumbel noise), ``inclusion`` (probability of a score above the best one left out; 1 where nothing
    is left out) and ``round_trip`` (the decoded ids are the text).

    Noise depends on ``seed`` and the row's key alone, so a rerun task repeats it and repeated
    rows get equal samples; a null key draws as the text "null". Null and empty texts have
    one empty segmentation of probability 1. A text with fewer than ``k`` segmentations has
    fewer rows; sets that hold less than 1e-12 of a unit's mass count as empty. Texts of any
    length are read whole. Existing columns of the added names are replaced.
    """
    rows = docs.drop(*ADDED)
    position, key_at = rows.columns.index(text), rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in slices(batches, ROWS, BYTES):
            yield from _sampled(vocab, batch, position, key_at, k, seed)

    return rows.mapInArrow(run, plus(
        rows.drop(text).schema,
        "sample int, ids array<int>, log_p double, perturbed double, inclusion double, round_trip boolean"))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with ``text`` decoded from their piece ids; null ids give null. An existing ``text`` is replaced."""
    rows = encoded.drop(text)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in slices(batches, ROWS, BYTES):
            found = [None if x is None else vocab.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, plus(rows.schema, f"`{text}` string"))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the model's own segmentation of every whole text as ``ids``, in place of the text.

    Null texts give null, empty ones no ids; repeated rows are encoded alike. An existing ``ids`` is replaced.
    """
    rows = docs.drop(ids)
    position = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if i != position]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path).model
        for batch in slices(batches, ROWS, BYTES):
            found = [None if x is None else model.encode(x) for x in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(found, pa.list_(pa.int32()))],
                names=[*[batch.schema.names[i] for i in kept], ids])

    return rows.mapInArrow(run, plus(rows.drop(text).schema, f"`{ids}` array<int>"))
