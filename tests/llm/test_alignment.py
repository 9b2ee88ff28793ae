"""Alignment of two tokenizers against whole-text encoding and plain dictionaries."""

from collections import Counter
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest

from claimbook.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


@lru_cache
def byte_of():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(texts):
    """Result rows by the definition: whole texts, byte ends, pairs in a dictionary."""
    first, second = libraries()
    cut = []
    for text in texts:
        cut.append(None)
        if not text:
            continue
        whole = (" " + text).encode()
        e = first.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(byte_of()[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode())
             for i in second.encode(text)]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            continue
        ends = [dict(zip(np.cumsum([len(x) for _, x in side]).tolist(), range(len(side)))) for side in (a, b)]
        groups, links, at = [], [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            to = ends[0][end] + 1, ends[1][end] + 1
            groups.append("|".join(",".join(str(i) for i, _ in side[f:t]) for side, f, t in zip((a, b), at, to)))
            links.append((a[to[0] - 1][0], b[to[1] - 1][0]))
            at = to
        cut[-1] = (len(a), len(b), groups, links)
    counts = Counter(k for c in cut if c for k in c[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return [
        (0, 0, 0, 0, 0, 0, "") if c is None else (
            c[0], c[1], len(c[2]), len(c[3]), sum(counts[k] == highest[k[1]] for k in c[3]), sum(counts[k] for k in c[3]),
            sha256(";".join(c[2]).encode()).hexdigest())
        for c in cut]


TEXTS = [
    None, "", " ", "  ", "a", "foo ", "foo  ", "foo  bar", " foo", "line\n\nnext\tword \n x", "x▁y", "▁", "<s> </s> <unk> <0x41>",
    "<|endoftext|> and<|endoftext|>", "naïve Größe straße 12345 1.5e-3", "日本語のテキスト 😀😀", "a b  c", "\x1c \x1f x", "it's we'll DON'T",
    "é ́", "word " * 3000, "x" * 5000, "The end. " * 40, "same text", "same text", "​ zero", "\r\n \r\n", "tab\t\tend ",
]


@pytest.mark.parametrize("partitions, records, fan_in, runs_a_task", [(32, 2_000_000, 64, 32), (3, 40, 2, 2)])
def test_equals_whole_texts(spark, partitions, records, fan_in, runs_a_task, monkeypatch):
    rows = [(i, t, "clash", 1, i % 3) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, run string, n_best int, bucket int").repartition(4)
    got = alignment.align(docs, A, B, partitions=partitions, records=records, fan_in=fan_in, runs_a_task=runs_a_task)
    assert got.columns == ["doc_id", "run", "bucket", *alignment.RESULT]
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[c] for c in alignment.RESULT) for r in got] == plain(TEXTS * 3)
    assert [(r["run"], r["bucket"]) for r in got] == [("clash", i % 3) for i in range(len(rows))]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r["doc_id"]: tuple(r[c] for c in alignment.RESULT) for r in alignment.align(docs, A, B, records=5_000, fan_in=2).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows]), strict=True))


def test_a_text_of_several_parts(spark):
    text = "".join(f"word{i % 977} ünd\n" for i in range(180_000))
    assert len(text) > 2 * alignment.CHUNK
    docs = spark.createDataFrame([(1, text), (2, "word5 ünd")], "doc_id int, text string")
    got = {r["doc_id"]: tuple(r[c] for c in alignment.RESULT) for r in alignment.align(docs, A, B).collect()}
    assert [got[1], got[2]] == plain([text, "word5 ünd"])


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id int, text string"), A, B).collect() == []


def test_parts_and_units_join_to_the_text():
    text = "  a bb  ccc\n dd  e f "
    for size in range(1, 20):
        parts = list(alignment.chunks_of(" " + text, size))
        assert "".join(parts) == " " + text
        assert [u for p in parts for u in alignment.units_of(p)] == alignment.units_of(" " + text)


def test_merge_sums_equal_pairs():
    rng = np.random.default_rng(5)
    runs, total = [], Counter()
    for n in (1, 50, 20_000, 9_000, 1):
        keys = np.unique(rng.integers(0, 30_000, n))
        times = rng.integers(1, 9, len(keys))
        runs.append(alignment._pack(alignment._deltas(keys), times))
        total.update(dict(zip(keys.tolist(), times.tolist())))
    got = [x for k, t in alignment.merge([alignment._blocks(r) for r in runs]) for x in zip(k.tolist(), t.tolist())]
    assert got == sorted(total.items())
