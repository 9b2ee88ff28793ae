import math
import random
from collections import Counter

import pytest

from claimbook.llm import contrast

SCHEMA = "doc_id long, text string, good boolean, row string, kept long, part int"


def _exact(texts, flags):
    words = [(t or "").lower().split() for t in texts]
    models = []
    for m in range(2):
        used = [w for w, flag in zip(words, flags, strict=True) if m or flag]
        models.append((Counter(x for w in used for x in w), Counter(p for w in used for p in zip(w, w[1:], strict=False))))
    vocabulary, out = len(models[1][0]), []
    for w in words:
        losses = []
        for count, pairs in models:
            loss, before, total = 0.0, None, sum(count.values())
            for x in w:
                p = (count[x] + contrast.FLOOR) / (total + contrast.FLOOR * vocabulary)
                if before is not None:
                    p = (pairs[before, x] + contrast.DISCOUNT_MASS * p) / (count[before] + contrast.DISCOUNT_MASS)
                loss, before = loss - math.log(p), x
            losses.append(loss / len(w) if w else None)
        out.append((len(w), *losses))
    return out


def _corpus():
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(1, 80))) for _ in range(90)]
    texts += [None, "", " \n", "once", texts[0], texts[0], "Same WORD " * 300, "tab\tand\x1cother spaces ΑΣ ς"]
    return texts, [None if i % 5 == 4 else i % 3 == 0 for i in range(len(texts))]


@pytest.mark.parametrize("bits, part, chunk, memo", [(9, 3_000_000, 2_000_000, 400_000), (4, 300, 100, 30), (0, 50, 1, 1)])
def test_losses_are_those_of_plain_counts(spark, monkeypatch, bits, part, chunk, memo):
    for name, value in (("HOT_BITS", bits), ("PART", part), ("CHUNK", chunk), ("MEMO", memo)):
        monkeypatch.setattr(contrast, name, value)
    texts, flags = _corpus()
    df = spark.createDataFrame([(i, t, f, "r", 7, None) for i, (t, f) in enumerate(zip(texts, flags, strict=True))], SCHEMA)
    rows = contrast.score_corpus(df.repartition(4), "good").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        n, a, b = _exact(texts, flags)[r["doc_id"]]
        assert (r["n_tokens"], r["row"], r["kept"], r["part"]) == (n, "r", 7, None)
        if n:
            assert (r["target_loss"], r["background_loss"], r["difference"]) == pytest.approx((a, b, a - b), rel=1e-9, abs=1e-12)
        else:
            assert r["target_loss"] is r["background_loss"] is r["difference"] is None


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(contrast, "LONG", 8)
    for text in ("", "short", "one two three four five six", "averyveryverylongword and others", "x" * 50, "a b " * 40):
        pieces = list(contrast._pieces(text))
        assert "".join(pieces) == text
        assert [w for p in pieces for w in p.split()] == text.split()


def test_nothing_to_count(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert contrast.score_corpus(df, "good").collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None, None), (None, " ", True, None, None, None)], SCHEMA)
    assert [(r["n_tokens"], r["difference"]) for r in contrast.score_corpus(nulls, "good").collect()] == [(0, None)] * 2
