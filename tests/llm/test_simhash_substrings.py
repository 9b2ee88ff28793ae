import random

import numpy as np

from claimbook.llm import simhash, substrings
from claimbook.llm.components import smallest_reachable
from reference_forms import components, fingerprint, without_repeats

ODD = [None, "", " \n\t ", "One", "one  TWO", "é è É", "a b c", "A\tb\nc", "x" * 5000, "word " * 3000]


def _texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 4):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    return texts + [texts[0]] * 5


def test_fingerprints_match_the_plain_form():
    for text in ODD + _texts(30, 1):
        assert simhash.fingerprint(text or "") == fingerprint(text)


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(5)
    for x in rng.integers(0, 1 << 63, 300):
        y = int(x)
        for b in rng.choice(64, 2, replace=False)[: rng.integers(0, 3)]:
            y ^= 1 << int(b)
        signed = np.array([y], np.uint64).view(np.int64)
        _, reached = simhash.anchors(signed, 2)
        low, high = np.array([int(x) & 0x7FFFFF]), np.array([(int(x) >> 23) & 0x7FFFFF])
        home = int(simhash._near(low, 0)[1][0] | (simhash._near(high, 0)[1][0] << 23))
        assert home in set(reached.tolist())


def test_code_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 5_000)
    row, code = simhash._near(words, 0)
    assert len(row) == len(words) and (simhash._syndromes(code) == 0).all()


def test_near_duplicates_match_all_pairs(spark):
    texts = _texts(80, 2) + ODD + [None]
    ids = list(range(10, 10 + len(texts)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string, first int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = [fingerprint(t) for t in texts]
    want = components(fps, ids)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, want, strict=True)}


def test_near_duplicates_of_null_keys_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "other words here now"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_long_paths_and_large_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    vertices = spark.createDataFrame([(i, i) for i in [*range(201), *range(1000, 1300), 5000]], "v long, n long")
    got = {r["v"]: r["label"] for r in smallest_reachable(spark.createDataFrame(pairs, "a long, b long"), vertices, "v", "n").collect()}
    assert got == {i: 0 if i <= 200 else 1000 if i < 5000 else 5000 for i in got} and len(got) == 502


def _passages(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.choice([12, 13, 14, 30, 80]))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages).split()
            a = rng.randrange(3)
            parts.insert(rng.randrange(len(parts) + 1), " ".join(p[a:]))
        docs.append((rng.randrange(10_000), "\n".join(parts)))
    return list({i: (i, t) for i, t in docs}.values())


def _cut(df, **options):
    rows = substrings.remove_repeats(df, **options).collect()
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows}


def test_repeats_match_the_plain_form(spark):
    docs = _passages(4) + [(20_000 + i, t) for i, t in enumerate(ODD)] + [(30_000, "word " * 40)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n int, words string")
    assert _cut(df) == without_repeats(docs)


def test_repeats_between_later_documents_only(spark):
    """A seed's first document lacks the windows that two later ones share."""
    shared = [f"s{i}" for i in range(4)]
    left = [f"l{i}" for i in range(9)]
    docs = [(1, " ".join(["q"] * 3 + shared + ["r"] * 12))]
    docs += [(i, " ".join([f"x{i}"] * 5 + left + shared + [f"y{i}"] * 5)) for i in (2, 3, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _cut(df) == without_repeats(docs)


def test_repeats_split_over_copies_of_a_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(substrings, "DOCS_PER_SHARD", 3)
    docs = [(i, f"start{i} " + " ".join(f"p{j}" for j in range(40)) + f" end{i}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _cut(df) == without_repeats(docs)


def test_repeats_of_null_and_equal_keys(spark):
    body = " ".join(f"w{i}" for i in range(20))
    rows = [(None, body), (None, body), (5, body), (5, body + " more"), (9, body), (9, body)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 0), ("5", 0), ("9", 20), ("9", 20), ("None", 0), ("None", 0)]
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_matching_statistics():
    rng = random.Random(9)
    text = rng.choices("abc", k=60)
    automaton = substrings.SuffixAutomaton()
    automaton.extend(text)
    stream = rng.choices("abcd", k=80)
    joined = "".join(text)
    for i, n in enumerate(automaton.matches(stream)):
        want = max(k for k in range(i + 2) if "".join(stream[i + 1 - k : i + 1]) in joined)
        assert n == want
