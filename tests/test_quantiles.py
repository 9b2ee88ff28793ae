import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claimbook.operators.quantiles import quantile_columns

PROBS = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}


def compare(df, data, by):
    got = {r[0] if by else None: r for r in quantile_columns(df, "v", PROBS, by).collect()}
    groups = {}
    for k, v in data:
        if v is not None and not np.isnan(v):
            groups.setdefault(k if by else None, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        want = np.quantile(values, list(PROBS.values()))
        np.testing.assert_allclose([got[k][n] for n in PROBS], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_matches_numpy_on_awkward_groups(spark, by):
    rng = np.random.default_rng(5)
    data = [("normal", float(x)) for x in rng.normal(size=2001)]
    data += [("heavy", float(x)) for x in np.exp(rng.normal(0, 6, size=1500))]
    data += [("ties", float(x)) for x in rng.integers(0, 4, size=999)]
    data += [("tight", 1e6 + float(x) * 1e-7) for x in rng.random(800)]
    data += [("negative", -float(x)) for x in np.exp(rng.normal(0, 3, size=700))]
    data += [("one", 42.0), ("empty", None), ("nan", float("nan")), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    compare(df, data, by)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=40))
def test_matches_numpy_on_any_list(spark, values):
    data = [("g", float(x)) for x in values]
    df = spark.createDataFrame(data, "k string, v double")
    row = quantile_columns(df, "v", PROBS).first()
    want = np.quantile(values, list(PROBS.values()))
    np.testing.assert_allclose([row[n] for n in PROBS], want, rtol=1e-9, atol=1e-6)


def test_one_group_may_hold_everything(spark):
    df = spark.range(20_000).selectExpr("'hot' AS k", "cast(id AS double) AS v")
    row = quantile_columns(df, "v", {"med": 0.5}, ["k"]).first()
    assert (row["k"], row["med"]) == ("hot", 9999.5)


def test_no_exact_percentile_buffer_in_the_plan(spark):
    df = spark.range(10).selectExpr("cast(id AS double) AS v")
    text = quantile_columns(df, "v", {"med": 0.5})._jdf.queryExecution().toString()
    assert "percentile(" not in text.lower()


def test_sketch_is_close(spark):
    df = spark.range(1001).selectExpr("cast(id AS double) AS v")
    assert abs(quantile_columns(df, "v", {"m": 0.5}, exact=False).first()["m"] - 500) <= 1


@pytest.mark.parametrize("cell_rows", [1, 50, 10_000])
def test_many_groups_of_all_sizes(spark, monkeypatch, cell_rows):
    from claimbook.operators import quantiles

    monkeypatch.setattr(quantiles, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(8)
    data = [(f"g{i % 9}" if i % 3 else None, float(x)) for i, x in enumerate(rng.normal(size=600))]
    data += [("copies", 1.0)] * 300
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    probs = {"q1": 0.25, "med": 0.5}
    got = {r["k"]: r for r in quantile_columns(df, "v", probs, ["k"]).collect()}
    for k in {k for k, _ in data}:
        want = np.quantile([v for g, v in data if g == k], [0.25, 0.5])
        np.testing.assert_allclose([got[k]["q1"], got[k]["med"]], want, rtol=1e-12)


def test_crowded_small_values_are_narrowed_until_few_share_a_cell(spark, monkeypatch):
    """All but one of the values lie far below the width of one logarithmic bin."""
    from claimbook.operators import quantiles

    monkeypatch.setattr(quantiles, "CELL_ROWS", 20)
    seen = []
    running = quantiles._running
    monkeypatch.setattr(quantiles, "_running", lambda cells, within, order: seen.append(len(within)) or running(cells, within, order))
    df = spark.range(20_000).selectExpr("id / 2e10 AS v").union(spark.createDataFrame([(0.015,)], "v double"))
    row = quantile_columns(df, "v", {"med": 0.5, "top": 0.999}).first()
    want = np.quantile([i / 2e10 for i in range(20_000)] + [0.015], [0.5, 0.999])
    np.testing.assert_allclose([row["med"], row["top"]], want, rtol=1e-12)
    assert max(seen) >= 4  # further rounds were worked
