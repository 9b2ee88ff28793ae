import math
import random
from collections import Counter

import pytest

from claimbook.llm import lm


def _exact(docs, flags, text, vocabulary):
    out = []
    for m in range(2):
        words, pairs = Counter(), Counter()
        for t, flag in zip(docs, flags, strict=True):
            if m or flag:
                w = t.lower().split()
                words.update(w)
                pairs.update(zip(w, w[1:], strict=False))
        total, loss, before = sum(words.values()), 0.0, None
        for x in text.lower().split():
            p = (words[x] + lm.FLOOR) / (total + lm.FLOOR * vocabulary)
            if before is not None:
                p = (pairs[before, x] + lm.DISCOUNT_MASS * p) / (words[before] + lm.DISCOUNT_MASS)
            loss, before = loss - math.log(p), x
        out.append(loss / len(text.split()))
    return out


@pytest.mark.parametrize("word_bits, pair_bits", [(3, 2), (18, 20)])
def test_counts_are_exact_with_more_words_and_pairs_than_classes(spark, monkeypatch, word_bits, pair_bits):
    monkeypatch.setattr(lm, "WORD_BITS", word_bits)
    monkeypatch.setattr(lm, "PAIR_BITS", pair_bits)
    monkeypatch.setattr(lm, "CHUNK", 50)
    rng = random.Random(7)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.randint(1, 60))) for _ in range(80)]
    flags = [i % 4 == 0 for i in range(80)]
    df = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(texts, flags, strict=True))], "doc_id long, text string, good boolean")
    models = lm.fit(df, "good")
    vocabulary = max(1 << word_bits, len({w for t in texts for w in t.split()}))
    others = ["never counted w1 w2", "w2 w1 never w1", texts[3] + " w1 w1 end"]
    asked = texts + others
    rows = lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(3), models).collect()
    assert len(rows) == len(asked)
    for r in rows:
        a, b = _exact(texts, flags, asked[r["doc_id"]], vocabulary)
        assert (r["target_loss"], r["background_loss"], r["difference"]) == pytest.approx((a, b, a - b), rel=1e-6, abs=1e-9)
