"""The network is fitted on every distinct window, in parts where there are many."""

import numpy as np

from claimbook.llm import secretscan
from test_secretscan import corpus, plain


def test_all_windows_are_fitted_in_parts(spark, monkeypatch):
    rows = corpus(2_500, 5)
    docs = spark.createDataFrame(rows, "doc_id int, text string, kind string, planted string")
    seen = {(secretscan.window(t, s, e), m) for _, t, *_ in rows for s, e, m in secretscan.candidates(t)}
    told, fitted = [], secretscan._fitted_apart

    def spy(windows, parts, good, bad, *more):
        told.append((parts, good, bad, windows.filter("use").count()))
        return fitted(windows, parts, good, bad, *more)

    monkeypatch.setattr(secretscan, "_fitted_apart", spy)
    got = {r["doc_id"]: r for r in secretscan.scan(docs, part=900).collect()}
    assert told[0][0] == told[2][0] > 1 and all(good + bad == n for _, good, bad, n in told)
    assert told[0][3] + told[1][3] == len(seen)
    hit, clean = [], []
    for i, text, kind, planted in rows:
        assert tuple(got[i][c] for c in secretscan.RESULT[:4]) == plain(text)[:4]
        added = [x.split(":") for x in got[i]["spans"].split(",") if x.startswith("net:")]
        if kind == "other":
            at = text.index(planted)
            hit.append(any(int(s) <= at and at + len(planted) <= int(e) for _, s, e in added))
        elif kind not in ("assign", "access", "hex"):
            clean.append(not added)
    assert np.mean(hit) >= 0.6 and np.mean(clean) >= 0.99


def test_calibration_and_thresholds_from_rows_equal_those_from_arrays(spark):
    rng = np.random.default_rng(2)
    y = rng.random(400) < 0.3
    z = rng.normal(size=400) + 2 * y
    rated = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(z, y, strict=True)], "z double, found boolean").repartition(4)
    assert np.allclose(secretscan._calibrated_rows(rated, int(y.sum()), int((~y).sum())), secretscan._calibrated(z, y.astype(float)), atol=1e-7)
    for share in (0.95, 0.99, 0.5):
        want = secretscan._reached(z[y], share)
        assert want - 2e-9 <= secretscan._reached_rows(rated.filter("found"), int(y.sum()), share) <= want
