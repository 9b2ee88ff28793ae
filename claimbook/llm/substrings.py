"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

1. Seeds. Of every window of 13 words the 4-word gram with the least hash is its seed, so
   equal windows have equal seeds. Seeds held by several documents name their first document.
2. Routing. The words around such seeds form spans. A span goes to the shard of its seed's
   first document, where that document's own spans are the reference. The reference of all
   shards together grows with the corpus, so shards are not broadcast to every task: a shard
   is sent only what shares a seed with it. A shard that many documents ask for is
   repeated, and each repetition serves a bounded number of them.
3. Matching. A suffix automaton of the reference is built per shard; spans are streamed
   through it for their matching statistics, and words under a match of 13 or more go.
4. The rest. A window whose seed is known but which the seed's first document does not hold can
   still be repeated between later documents. These few windows are compared by a 64-bit
   hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimbook.llm.tables import slices

GRAM = 4
DOCS_PER_SHARD = 256
MEMO = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Hashes of the words of texts; a word is a run of characters that are not ASCII white space."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of the texts in a row, and the owning text of each."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        full = pc.not_equal(pc.binary_length(words), 0)
        if not pc.all(full).as_py():
            words, owner = words.filter(full), owner[full.to_numpy(zero_copy_only=False)]
        return words, owner

    def hashes(self, words: pa.Array) -> np.ndarray:
        """Hash of every word; each distinct word is hashed once while it is remembered."""
        coded = words.dictionary_encode()
        known = self.known
        if len(known) > MEMO:
            known.clear()
        distinct = coded.dictionary.to_pylist()
        found = [known.get(w) for w in distinct]
        for i, h in enumerate(found):
            if h is None:
                found[i] = known[distinct[i]] = xxh64_intdigest(distinct[i])
        return np.array(found, np.uint64)[coded.indices.to_numpy()]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbours."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : m + i]) * MIX
        out ^= out >> np.uint64(32)
    return out


def seeds(h: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window inside one text, and its seed: the least gram hash in it."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, width, covered = rolled(h, GRAM), window - GRAM + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    start = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return start, least[start]


def _joined(words: pa.Array, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """Stretches of the words, each joined by one space."""
    ends = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(first - ends[:-1], length) + np.arange(ends[-1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(at))), " ")


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words()
        for batch in slices(batches, 4096):
            words, owner = vocabulary.split(batch.column(1))
            start, seed = seeds(vocabulary.hashes(words), owner, window)
            doc = owner[start]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
            seed, doc = seed[new], doc[new]
            order = np.lexsort((seed, doc))
            seed, doc = seed[order], doc[order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[new].view(np.int64)), batch.column(0).take(pa.array(doc[new]))], names=["seed", "doc"])

    return run


SPANS = "shard long, copy int, is_reference boolean, doc long, tag long, start int, words string, asked binary"


def _span_rows(window: int):
    names = ["shard", "copy", "is_reference", "doc", "tag", "start", "words", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words()
        for batch in slices(batches, 2048):
            docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat, owner = vocabulary.split(batch.column(2))
            starts, found = seeds(vocabulary.hashes(flat), owner, window)
            text_at = np.searchsorted(owner, np.arange(len(docs)))
            window_at = np.searchsorted(owner[starts], np.arange(len(docs) + 1))
            lists = batch.column(3)
            at_list, known = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            all_seed, all_first, all_held = (known.field(i).to_numpy() for i in range(3))
            rows: list[list] = [[] for _ in names]
            places = rows[names.index("words")]
            for i, (doc, tag) in enumerate(zip(docs, tags, strict=True)):
                lo, hi = window_at[i], window_at[i + 1]
                if lo == hi:
                    continue
                seed = all_seed[at_list[i] : at_list[i + 1]].view(np.uint64)
                order = np.argsort(seed)
                seed = seed[order]
                wanted = found[lo:hi]
                at = np.minimum(np.searchsorted(seed, wanted), len(seed) - 1)
                hit = np.flatnonzero(seed[at] == wanted)
                if not len(hit):
                    continue
                entry = order[at[hit]] + at_list[i]
                start, first, held = starts[lo:hi][hit] - text_at[i], all_first[entry], all_held[entry]
                order = np.lexsort((start, first))
                start, first = start[order], first[order]
                opens = np.ones(len(start), bool)
                opens[1:] = (first[1:] != first[:-1]) | (start[1:] - start[:-1] > window)
                cuts = np.flatnonzero(opens).tolist()
                most = {}
                for shard, n in zip(first.tolist(), held[order].tolist(), strict=True):
                    if n > most.get(shard, 0):
                        most[shard] = n
                draw = xxh64_intdigest(str(doc))
                for a, b in zip(cuts, [*cuts[1:], len(start)], strict=True):
                    shard, here = int(first[a]), start[a:b]
                    copies = -(-most[shard] // DOCS_PER_SHARD)
                    mine = shard == doc
                    low, high = int(here[0]), int(here[-1]) + window
                    asked = np.zeros(high - low, bool)
                    asked[here - low] = True
                    place, bits = (text_at[i] + low, high - low), np.packbits(asked).tobytes()
                    for copy in range(copies) if mine else (draw % copies,):
                        for column, value in zip(rows, (shard, copy, mine, doc, tag, low, place, bits), strict=True):
                            column.append(value)
            spans = np.array(places, np.int64).reshape(-1, 2)
            rows[names.index("words")] = _joined(flat, spans[:, 0], spans[:, 1])
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(rows, kinds, strict=True)],
                names=names)

    return run


class SuffixAutomaton:
    """Suffix automaton over words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def extend(self, words) -> None:
        """Append words to the text of the automaton."""
        step, link, length, last = self.next, self.link, self.length, self.last
        for word in words:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in step[p]:
                step[p][word] = cur
                p = link[p]
            if p >= 0:
                q = step[p][word]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(word) == q:
                        step[p][word] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def matches(self, words) -> list[int]:
        """Matching statistics: length of the longest suffix of each prefix that the text holds."""
        step, link, length = self.next, self.link, self.length
        state, run, out = 0, 0, []
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                run = length[state]
            if word in step[state]:
                state = step[state][word]
                run += 1
            out.append(run)
        return out


FOUND = "doc long, tag long, low int, high int, hash long"


def _match(window: int):
    """Parts to cut (no hash), and windows of known seed that the reference lacks (with their hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shard, reference, automaton = Words(), None, [], None
        for batch in slices(batches, 4096):
            doc, tag, low, high = [], [], [], []
            rest, bodies = [], []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for i, (key, copy, mine, name, mark, start, body, bits) in enumerate(rows):
                if (key, copy) != shard:
                    shard, reference, automaton = (key, copy), [], None
                if mine:
                    reference.append(body)
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton()
                    for number, text in enumerate(reference):
                        automaton.extend(text.split(" "))
                        automaton.extend([number])  # a word of its own between spans
                    reference = []
                words = body.split(" ")
                ends = [e for e, n in enumerate(automaton.matches(words)) if n >= window]
                asked = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words))
                if ends:
                    asked[np.array(ends) - (window - 1)] = 0
                    first = last = ends[0]
                    for e in [*ends[1:], None]:
                        if e is None or e - last > window:
                            doc.append(name)
                            tag.append(mark)
                            low.append(start + first - window + 1)
                            high.append(start + last + 1)
                            first = e
                        last = e
                left = np.flatnonzero(asked)
                if len(left):
                    rest.append((i, name, mark, start, left))
                    bodies.append(body)
            direct = len(doc)
            hashed = np.zeros(0, np.uint64)
            if rest:
                flat, owner = vocabulary.split(pa.array(bodies, pa.string()))
                windows = rolled(vocabulary.hashes(flat), window)
                at = np.searchsorted(owner, np.arange(len(bodies)))
                count = [len(r[4]) for r in rest]
                hashed = windows[np.concatenate([r[4] + a for r, a in zip(rest, at, strict=True)])]
                doc = np.concatenate([np.array(doc, np.int64), np.repeat([r[1] for r in rest], count)])
                tag = np.concatenate([np.array(tag, np.int64), np.repeat([r[2] for r in rest], count)])
                begin = np.concatenate([r[4] + r[3] for r in rest])
                low, high = np.concatenate([np.array(low, np.int64), begin]), np.concatenate([np.array(high, np.int64), begin + window])
            mask = np.zeros(len(doc), bool)
            mask[:direct] = True
            padded = np.concatenate([np.zeros(direct, np.int64), hashed.view(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                 pa.array(padded, pa.int64(), mask=mask)],
                names=["doc", "tag", "low", "high", "hash"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = Words()
    for batch in slices(batches, 2048):
        words, owner = vocabulary.split(batch.column(2))
        n = batch.num_rows
        at = np.searchsorted(owner, np.arange(n + 1))
        lists = batch.column(3)
        spans, where = lists.flatten(), lists.offsets.to_numpy()
        row = np.repeat(np.arange(n), np.diff(where))
        tag, low, high = (spans.field(i).to_numpy() for i in range(3))
        mine = tag == batch.column(1).to_numpy()[row]
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, at[row[mine]] + low[mine], 1)
        np.add.at(gone, at[row[mine]] + high[mine], -1)
        stay = np.cumsum(gone)[:-1] == 0
        left = np.bincount(owner[stay], minlength=n)
        kept = words if stay.all() else words.filter(pa.array(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(np.diff(at) - left, pa.int64()),
             _joined(kept, np.cumsum(left) - left, left)],
            names=["doc", "tag", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """``key, n_words, n_removed, kept`` (the words that stay, joined by one space) of every row.

    Words are runs of characters other than space and the control characters 9 to 13. A word
    goes if a window of ``window`` words that covers it also starts in a document with a
    smaller key; windows are those of the input, not of what is left. The first document
    that holds a passage keeps it.

    Null texts have no words; texts shorter than a window keep all. Rows with a null key have
    no order: they lose nothing and take nothing. Rows that share a key do not affect each
    other and are cut each by its own text; exact repeats are cut alike. Texts are read
    whole, an empty table gives no rows, other columns do not matter.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    base = rows.filter("doc is not null").select("doc", F.xxhash64("body").alias("tag"), "body")
    held = base.select("doc", "body").mapInArrow(_seed_rows(window), "seed long, doc long")
    shared = held.groupBy("seed").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = held.join(shared, "seed").groupBy("doc").agg(F.collect_list(F.struct("seed", "first", "n")).alias("known"))
    spans = base.join(hits, "doc").mapInArrow(_span_rows(window), SPANS)
    found = (
        spans.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("is_reference").desc())
        .mapInArrow(_match(window), FOUND)
    )
    # Parts to cut are dealt out under keys of their own beside the open windows, so the
    # matching is worked once for the totals and once for all that is looked up in them.
    earliest = (
        found.filter("hash is not null").groupBy("hash")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
        .select(F.col("hash").alias("key"), "first")
    )
    dealt = found.withColumn("key", F.coalesce("hash", F.xxhash64("doc", "tag", "low")))
    cuts = (
        dealt.join(earliest, "key", "left").filter("hash is null or first < doc")
        .groupBy("doc").agg(F.collect_list(F.struct("tag", "low", "high")).alias("parts"))
    )
    done = "doc long, tag long, n_words long, n_removed long, kept string"
    keyed = base.join(cuts, "doc", "left").select("doc", "tag", "body", "parts")
    nameless = rows.filter("doc is null").select(
        "doc", F.lit(0).cast("long").alias("tag"), "body",
        F.lit(None).cast(keyed.schema["parts"].dataType).alias("parts"))
    return keyed.mapInArrow(_cut, done).union(nameless.mapInArrow(_cut, done)).select(
        F.col("doc").alias(key), "n_words", "n_removed", "kept")


SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS body
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (SELECT body, min(doc_id) AS first FROM windows GROUP BY body),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest(range(i + 1, i + 14)) AS p FROM windows JOIN firsts USING (body) WHERE first < doc_id)
  GROUP BY doc_id
), places AS (
  SELECT words.doc_id, w, coalesce(gone, []) AS gone FROM words LEFT JOIN gone USING (doc_id)
), marked AS (
  SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)
), stay AS (
  SELECT m.doc_id, string_agg(word, ' ' ORDER BY m.p) AS kept
  FROM marked m ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM gone) g ON m.doc_id = g.doc_id AND m.p = g.p
  GROUP BY m.doc_id
)
SELECT places.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places.gone) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM places LEFT JOIN stay USING (doc_id)
"""
