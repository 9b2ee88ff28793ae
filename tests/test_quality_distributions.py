import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimbook.operators import distributions as dist
from claimbook.operators import quality

D = dt.date


def test_summary_with_an_all_null_column(spark):
    df = spark.createDataFrame(
        [(1.0, None), (2.0, None), (3.0, None), (4.0, None)], "a double, b double"
    )
    got = {r["name"]: r for r in quality.summarize_columns(df, ["a", "b"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["min"], a["q1"], a["median"], a["q3"], a["max"]) == (1.0, 1.75, 2.5, 3.25, 4.0)
    assert (b["min"], b["median"], b["n_null"]) == (None, None, 4)


def test_null_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert [tuple(r) for r in quality.null_profile(df).orderBy("name").collect()] == [
        ("a", 0, None),
        ("b", 0, None),
    ]


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 3, None)], "a int, `b c` int, d string")
    assert quality.columns_with_nulls(df) == ["b c", "d"]


def test_reconciliations_find_exactly_the_planted_rows(spark):
    df = spark.createDataFrame(
        [(1, 50.0, 100.0, 0.5, 2, 1, 3), (2, 50.0, 100.0, 0.502, 2, 2, 3), (3, 1.0, 0.0, None, 1, None, 3)],
        "id int, loss double, premium double, ratio double, p int, q int, total int",
    )
    assert [r["id"] for r in quality.check_ratio(df, "loss", "premium", "ratio").collect()] == [2]
    assert [r["id"] for r in quality.check_sum(df, ["p", "q"], "total").collect()] == [2]


def test_check_equal(spark):
    same = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0 + 1e-9)], "a double, b double")
    assert quality.check_equal(same, "a", "b").first()["is_equal"] is True
    other = spark.createDataFrame([(1.0, 1.1), (5.0, None)], "a double, b double")
    row = quality.check_equal(other, "a", "b").first()
    assert row["is_equal"] is False and row["n_null_mismatch"] == 1


def test_rate_over_zero_time_is_reported(spark):
    df = spark.createDataFrame([(1, 90.0, 1.0), (2, 5.0, 0.0), (3, 0.0, 0.0), (4, 1.0, 1.0)],
                               "id int, miles double, hours double")
    assert sorted(r["id"] for r in quality.check_rate(df, "miles", "hours", 80).collect()) == [1, 2]


def test_order_grain_subkeys_scope_and_cap(spark):
    df = spark.createDataFrame(
        [("c1", "f1", "in", D(2020, 1, 2), D(2020, 1, 1), 5.0),
         ("c1", "f2", "out", D(2020, 1, 1), D(2020, 2, 1), 10.0),
         ("c2", "f1", "out", D(2020, 1, 1), D(2020, 3, 1), 0.0)],
        "claim string, feature string, scope string, loss date, at date, amount double",
    )
    assert quality.check_order(df, "loss", "at").count() == 1
    assert tuple(quality.check_grain(df, ["claim"]).first()) == (3, 2, False)
    assert tuple(quality.check_grain(df, ["claim", "feature"]).first()) == (3, 3, True)
    assert [tuple(r) for r in quality.check_subkeys(df, ["claim"], "feature").collect()] == [("c1", 2)]
    assert quality.check_scope(df, "scope", ["in"], "amount").count() == 1
    assert quality.check_cap(df, "amount", 5.0, ["claim"], "at").count() == 1
    assert quality.check_cap(df, "amount", 5.0).count() == 2


def test_shares_keep_the_null_group(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = {r["k"]: r["share"] for r in dist.value_shares(df, ["k"]).collect()}
    assert got == {"a": 0.5, "b": 0.25, None: 0.25}


@pytest.mark.parametrize("by", [[], ["k"]])
def test_histogram_matches_numpy(spark, by):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, 10.0, 500)
    k = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, x)], "k int, x double")
    got = dist.histogram(df, "x", bins=12, by=by, share="all").collect()
    edges = np.linspace(x.min(), x.max(), 13)
    for group in [0, 1, 2] if by else [None]:
        want, _ = np.histogram(x if group is None else x[k == group], edges)
        cells = sorted((r["bin"], r["n_rows"]) for r in got if group is None or r["k"] == group)
        assert cells == list(enumerate(want.tolist()))
    assert sum(r["share"] for r in got) == pytest.approx(1.0)


def test_histogram_of_constant_empty_and_limited_data(spark):
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["n_rows"] for r in dist.histogram(flat, "x", bins=3).orderBy("bin").collect()] == [2, 0, 0]
    assert dist.histogram(flat.limit(0), "x").count() == 0
    wide = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 100)], "x double")
    got = dist.histogram(wide, "x", bins=2, limits=(None, 3.0)).orderBy("bin").collect()
    assert [r["n_rows"] for r in got] == [1, 2]


def test_fixed_width_bins_start_at_the_origin(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (99.9,), (100.0,)], "x double")
    got = dist.histogram(df, "x", width=100).orderBy("bin").collect()
    assert [(r["bin"], r["bin_start"], r["n_rows"]) for r in got] == [
        (-1, -100.0, 1), (0, 0.0, 2), (1, 100.0, 1)
    ]


def test_box_statistics(spark):
    values = [float(v) for v in range(1, 21)] + [200.0, -90.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("s", 7.0)], "k string, x double")
    got = {r["k"]: r for r in dist.box_stats(df, "x", ["k"]).collect()}
    q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    g = got["g"]
    assert (g["q1"], g["median"], g["q3"]) == (q1, med, q3)
    assert (g["whisker_low"], g["whisker_high"], g["n_outliers"]) == (1.0, 20.0, 2)
    assert (got["s"]["median"], got["s"]["n_outliers"]) == (7.0, 0)


def test_scatter_grid(spark):
    df = spark.createDataFrame([(1.0, 10.0), (1.5, 12.0), (9.0, None)], "x double, y double")
    got = [tuple(r) for r in dist.paired_bins(df, "x", "y", 2.0, 5.0).collect()]
    assert got == [(0.0, 10.0, 2)]


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("k"), (F.col("id") * 1.5).alias("x"))
    def table(d):
        return sorted(tuple(r) for r in dist.histogram(d, "x", bins=5, by=["k"]).collect())

    assert table(df.repartition(1)) == table(df.repartition(9, "k"))
