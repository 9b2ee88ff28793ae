import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimbook.llm import decontaminate, language, licences, lm, pieces, tokens
from claimbook.llm.queries import tokenizer_file

ODD = [None, "", " ", "\n\n", "  two  spaces ", "don't'll  <|endoftext|> x<|endoftext|>", "<|endoftext|>", "é ñ 　 z",
       "12 345", "tab\tand\x0bmore \r\n", "a" * 3000, "👍🏽 ok", "word " * 400]


def _text_rows(spark, texts, extra="x"):
    return spark.createDataFrame(
        [(i, t, extra) for i, t in enumerate(texts)] + [(None, "null key", extra), (0, texts[0], extra)],
        "doc_id long, text string, n_tokens string")


# -- tokens ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def _fuzz(rng):
    parts = ["the", " ", "  ", "\n", "é", "x1", "'s", "...", " ", "<|endoftext|>", "<|endof", "\t", "Ω", "supercali"]
    return "".join(rng.choices(parts, k=rng.randint(0, 300)))


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 512), (40, 4), (25, 16)])
def test_counts_are_those_of_the_whole_text(tokenizer, chunk, overlap):
    rng = random.Random(chunk)
    units = tokens.Units(tokenizer_file("byte_bpe_50k.json"), memo=50)
    for text in [t or "" for t in ODD] + [_fuzz(rng) for _ in range(150)]:
        assert units.count(text, chunk, overlap) == len(tokenizer.encode(text, add_special_tokens=False).ids), text[:80]


def test_units_join_to_the_text():
    units = tokens.Units(tokenizer_file("byte_bpe_50k.json"))
    assert all("".join(units.split(t or "")) == (t or "") for t in ODD)


def test_token_rows(spark, tokenizer):
    got = tokens.count_tokens(_text_rows(spark, ODD), tokenizer_file("byte_bpe_50k.json"), limit=300)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = "null key" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 300)
    assert tokens.count_tokens(_text_rows(spark, ODD).limit(0), tokenizer_file("byte_bpe_50k.json")).collect() == []


# -- language ----------------------------------------------------------------------------

def test_language_is_learned_outside_the_held_out_fold(spark):
    import zlib

    rng = random.Random(0)
    sounds = {"aa": "the thing of and", "bb": "der und nicht ein", "cc": "que los una para"}
    data = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        data.append((i, " ".join(rng.choices(sounds[lang].split(), k=rng.randint(1, 30))), lang, "p", 1.0))
    data += [(1000, None, "aa", "p", 1.0), (1001, "123 ... !!", "aa", "p", 1.0), (1002, "the thing of", None, "p", 1.0),
             (1003, "", None, "p", 1.0), (None, "der und nicht", "bb", "p", 1.0), (5, data[5][1], data[5][2], "p", 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.fit(docs)
    assert model.languages == ("aa", "bb", "cc") and model.log_p.shape == (1 << language.BITS, 3)
    rows = language.predict(docs.withColumn("held", language.is_held_out("doc_id")), model).collect()
    assert len(rows) == len(data)
    for r in rows:
        assert 0.0 <= r["score"] <= 1.0
        if r["doc_id"] is not None:
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (1000, 1001, 1003):
            assert r["lang_pred"] == "und" and r["score"] == 0.0
        elif r["doc_id"] != 1002:
            assert r["lang_pred"] == r["lang"]
        else:
            assert r["lang_pred"] == "aa"


def test_language_never_sees_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "xx" if i % 2 else "yy") for i in range(200)], "doc_id long, text string, lang string")
    held = docs.filter(language.is_held_out("doc_id"))
    assert held.count() > 10 and language.fit(held).languages == ()
    changed = docs.withColumn("lang", F.when(language.is_held_out("doc_id"), "zz").otherwise(F.col("lang")))
    one, two = language.fit(docs), language.fit(changed)
    assert one.languages == two.languages and np.array_equal(one.log_p, two.log_p)


def test_language_sample_is_bounded_and_an_empty_model_is_undecided(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("xx").alias("lang"))
    model = language.fit(docs, max_rows_per_language=100)
    assert model.languages == ("xx",)
    none = language.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(docs.limit(3), none).collect()} == {("und", 0.0)}


# -- segmentations -----------------------------------------------------------------------

MODEL = tokenizer_file("piece_bpe_32k.model")


def _all_segmentations(text):
    vocab = pieces.vocabulary(MODEL)
    whole = vocab.model.normalize(text)
    known = {vocab.model.id_to_piece(i): i for i in range(vocab.size) if np.isfinite(vocab.log_p[i])}
    out = []

    def walk(at, ids, log_p):
        if at == len(whole):
            out.append((tuple(ids), log_p))
        for end in range(at + 1, min(len(whole), at + 16) + 1):
            if whole[at:end] in known:
                i = known[whole[at:end]]
                walk(end, [*ids, i], log_p + vocab.log_p[i])

    walk(0, [], 0.0)
    total = np.logaddexp.reduce([x[1] for x in out])
    return {ids: math.exp(log_p - total) for ids, log_p in out}


def test_segmentations_are_a_sample_without_replacement():
    p = _all_segmentations("ab c")
    n = 20_000
    seeds = pieces._mixed(np.arange(n, dtype=np.uint64) * pieces.MIX_A)
    search = pieces.Search(pieces.vocabulary(MODEL), ["ab c"] * n, seeds)
    samples, kappa = search.run(3)
    drawn = []
    for s in samples:
        ids, count = search.pieces(s)
        ends = np.concatenate([[0], np.cumsum(count)])
        drawn.append([tuple(ids[ends[i] : ends[i + 1]].tolist()) for i in range(n)])
        assert np.allclose(np.bincount(search.owner, s["log_p"], minlength=n), [math.log(p[d]) for d in drawn[-1]])
    assert all(len(set(x)) == 3 for x in zip(*drawn, strict=True))
    tops = np.stack([*[s["top"] for s in samples], kappa])
    assert (np.diff(tops, axis=0) <= 0).all()
    expected = [Counter(), Counter(), Counter()]
    for a, b, c in itertools.permutations(p, 3):
        chance = p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])
        for counter, x in zip(expected, (a, b, c), strict=True):
            counter[x] += chance
    for counter, seen in zip(expected, drawn, strict=True):
        assert max(abs(counter[x] - seen.count(x) / n) for x in p) < 0.02


def test_segmentation_rows(spark):
    texts = [None, "", " ", "a", "hello world", "mañana ▁ 😀\n\tx", "z" * 400, "the cat " * 300]
    df = _text_rows(spark, texts, "ids")
    got = pieces.sample_segmentations(df, MODEL, k=3)
    rows = got.collect()
    again = pieces.sample_segmentations(df.repartition(3), MODEL, k=3).collect()
    order = lambda r: (str(r["doc_id"]), r["sample"], r["ids"])
    assert sorted(map(order, rows)) == sorted(map(order, again))
    assert all(r["round_trip"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [len(by[i]) for i in (0, 1)] == [2, 1]  # text 0 is there twice
    assert by[1][0]["ids"] == [] and by[1][0]["log_p"] == 0.0 and by[1][0]["inclusion"] == 1.0
    assert len(by[2]) == 2  # "▁▁" and "▁", "▁" are all there is
    for i in (4, 5, 6, 7, None):
        assert [r["sample"] for r in sorted(by[i], key=lambda r: r["sample"])] == [1, 2, 3]
        assert len({tuple(r["ids"]) for r in by[i]}) == 3
        assert all(0.0 <= r["inclusion"] <= 1.0 and r["log_p"] <= 0.0 for r in by[i])
    assert pieces.sample_segmentations(df.limit(0), MODEL).collect() == []


def test_decoding_returns_the_texts(spark):
    texts = ["hello  world", "línea\nnueva", "", "日本語 text", "tail "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = pieces.decode(pieces.sample_segmentations(df, MODEL, k=1), MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts))
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing, MODEL).first()["text"] is None


# -- language-model scores ---------------------------------------------------------------

def _plain_losses(docs, flags, text, word_bits=lm.WORD_BITS, pair_bits=lm.PAIR_BITS):
    from xxhash import xxh64_intdigest

    def classes(t):
        h = [xxh64_intdigest(w.encode()) for w in (t or "").lower().split()]
        pairs = [((((a * 0x9E3779B97F4A7C15) ^ b) & (2**64 - 1)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)) >> (64 - pair_bits)
                 for a, b in zip(h, h[1:])]
        return [x >> (64 - word_bits) for x in h], pairs

    out = []
    for m in range(2):
        words, pairs = Counter(), Counter()
        for t, flag in zip(docs, flags, strict=True):
            if m or flag:
                w, p = classes(t)
                words.update(w)
                pairs.update(p)
        w, p = classes(text)
        total = sum(words.values())
        loss = 0.0
        for i, x in enumerate(w):
            base = (words[x] + lm.FLOOR) / (total + lm.FLOOR * 2**word_bits)
            if i:
                base = (min(pairs[p[i - 1]], words[w[i - 1]]) + lm.DISCOUNT_MASS * base) / (words[w[i - 1]] + lm.DISCOUNT_MASS)
            loss -= math.log(base)
        out.append(loss / len(w) if w else None)
    return out


def test_language_model_differences_match_the_plain_form(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("Ann ran to the red house and sat".split(), k=rng.randint(1, 40))) for _ in range(60)]
    texts += [None, "", "unseen words only", "the " * 2000]
    flags = [i % 3 == 0 for i in range(len(texts))]
    flags[1] = None
    df = spark.createDataFrame(
        [(i, t, f, 0) for i, (t, f) in enumerate(zip(texts, flags, strict=True))], "doc_id long, text string, good boolean, difference int")
    rows = lm.score(df.repartition(4), lm.fit(df.repartition(5), "good")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        a, b = _plain_losses(texts, flags, texts[r["doc_id"]])
        assert r["n_tokens"] == len((texts[r["doc_id"]] or "").split())
        if a is None:
            assert r["target_loss"] is r["background_loss"] is r["difference"] is None
        else:
            assert (r["target_loss"], r["background_loss"], r["difference"]) == pytest.approx((a, b, a - b), rel=1e-5, abs=1e-6)
    empty = df.limit(0)
    assert lm.score(empty, lm.fit(empty, "good")).collect() == []


# -- licences ----------------------------------------------------------------------------

def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit = "<p>Released under the MIT License.</p>"
    gpl = "x\nThis work is licensed under the GNU General Public License, version 3.\ny"
    pages = [
        (1, "https://h.org/a/index?x=1", mit), (2, "http://h.org/a/b/c/page#top", "plain"), (3, "h.org/a/b/lic", gpl),
        (4, "https://h.org/a/b/c/d/", None), (5, "https://other.org/a/x", ""), (6, None, mit), (7, None, "none"),
        (8, "h.org/a/other", "licence to nothing in particular"), (9, "root", mit), (3, "h.org/a/b/lic", gpl), (None, "h.org/a/z", "t"),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, licence string")
    got = {r["page_id"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in licences.scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "h.org/a/b"), 3: ("GPL-3.0", "GPL-3.0", None),
        4: (None, "GPL-3.0", "h.org/a/b"), 5: (None, None, None), 6: ("MIT", "MIT", None), 7: (None, None, None),
        8: (None, "MIT", "h.org/a"), 9: ("MIT", "MIT", None), None: (None, "MIT", "h.org/a"),
    }
    assert licences.scan(df.limit(0)).collect() == []


def test_every_template_finds_itself(spark):
    df = spark.createDataFrame(list(licences.TEMPLATES), "name string, notice string")
    got = {r["notice"]: (r["licence"], r["cosine"]) for r in licences.similarities(df).collect()}
    assert got == {body: (name, 1.0) for name, body in licences.TEMPLATES}


# -- decontamination ---------------------------------------------------------------------

ITEMS = [
    (1, "A farmer named Anna has 12 apples and gives Boris 5 apples. How many apples does Anna keep after that day?"),
    (2, "short item of six words"),
    (3, None),
    (4, ""),
    (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
]


def _found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["n_matched"], r["reworded"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_items_are_found_also_with_other_values(spark):
    item = ITEMS[0][1]
    other = item.replace("Anna", "Clara").replace("Boris", "David").replace("12", "340").replace("5", "7.5")
    mixed = item.replace("Anna has", "Clara has").replace("12", "9")  # Anna stands for Clara here and for Anna there
    texts = [
        (1, item), (2, "Some lines before.\n" + item.lower().replace("anna", "Anna").replace("boris", "Boris") + " And after."),
        (3, other), (4, mixed), (5, "nothing of the kind " * 50), (6, None), (7, ""), (8, " ".join(str(i) for i in range(3000))),
        (9, item[:60]), (10, "we saw a short item of six words here"), (11, "a short item of six other words"), (12, item), (12, item),
        (None, item), (13, ("x " * 20_000) + other),
    ]
    got = _found(spark, texts)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (10, 2), (12, 1), (13, 1)}
    assert not got[1, 1][1] and got[3, 1][1] and got[13, 1][1] and not got[10, 2][1]
    assert got[1, 1][0] == 21


def test_a_changed_word_does_not_hide_an_item(spark):
    words = [f"lit{i}" for i in range(30)]
    changed = [*words[:14], "other", *words[15:]]
    got = _found(spark, [(1, " ".join(changed)), (2, " ".join(words[9:21])), (3, " ".join(words[9:22]))], [(7, " ".join(words))])
    assert got == {(1, 7): (29, False), (3, 7): (13, False)}


def test_many_items_share_one_bit_table(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"v{rng.randrange(5000)}" for _ in range(20))) for i in range(300)]
    docs = [(i, "lead in " + items[i][1] + " out" if i % 2 else " ".join(f"v{rng.randrange(5000)}" for _ in range(40))) for i in range(60)]
    assert set(_found(spark, docs, items)) == {(i, i) for i in range(1, 60, 2)}
    assert _found(spark, docs, items[:1]) == {}
    assert _found(spark, [], items) == {} and _found(spark, docs, [(1, None)]) == {}
