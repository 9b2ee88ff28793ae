import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimbook.operators import reshape, timeseries


def test_pivot_is_one_shuffle_and_zero_filled(spark):
    df = spark.createDataFrame(
        [(1, 2015, "_f", 5.0), (1, 2015, "_f", 7.0), (2, 2016, "_nf", 1.0), (2, 1999, "_f", 9.0)],
        "id int, y int, s string, amt double",
    )
    names = {"2015__f": (2015, "_f"), "2016__nf": (2016, "_nf")}
    wide = reshape.pivot_measure(df, "id", ["y", "s"], names, reshape.sum_of("amt"), 0.0)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 12.0, 0.0), (2, 0.0, 1.0)]
    counts = reshape.pivot_measure(df, "id", ["y", "s"], names, reshape.row_count())
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 2, 0), (2, 0, 1)]


def test_name_patterns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "hhld_id int, Min_AGE int, veh_w_x int, other int")
    assert reshape.columns_matching(df, contains="age") == ["Min_AGE"]
    assert reshape.columns_matching(df, starts_with=["VEH_W"]) == ["veh_w_x"]


def test_unpivot_family_labels_come_from_names(spark):
    df = spark.createDataFrame([(1, 2, 3.5)], "id int, Perc_Coll int, Perc_Comp double")
    got = reshape.unpivot_family(df, ["id"], r"Perc_(.*)", "covg", "share")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "Coll", 2.0), (1, "Comp", 3.5)]
    with pytest.raises(ValueError):
        reshape.unpivot_family(df, ["id"], r"nothing_(.*)")


def month(i):
    return dt.date(2010 + i // 12, i % 12 + 1, 1)


def test_gaps_become_visible_rows(spark):
    df = spark.createDataFrame([(month(0), 1), (month(3), 4)], "month date, n int")
    got = [tuple(r) for r in timeseries.month_spine(df).orderBy("month").collect()]
    assert got == [(month(0), 1), (month(1), None), (month(2), None), (month(3), 4)]


@pytest.mark.parametrize("model", ["multiplicative", "additive"])
def test_decomposition_recovers_a_planted_pattern(spark, model):
    rng = np.random.default_rng(0)
    season = rng.uniform(0.5, 1.5, 12)
    season = season / season.mean() if model == "multiplicative" else season - season.mean()
    level = {"a": 100.0, "b": 7.0}
    rows = [
        (k, month(i), float(v * season[i % 12] if model == "multiplicative" else v + season[i % 12]))
        for k, v in level.items()
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "k string, month date, x double").repartition(4)
    got = timeseries.decompose(df, "month", "x", ["k"], model).collect()
    assert len(got) == 120
    for r in got:
        i = (r["month"].year - 2010) * 12 + r["month"].month - 1
        assert r["seasonal"] == pytest.approx(season[i % 12])
        if i < 6 or i >= 54:
            assert r["trend"] is None and r["remainder"] is None
        else:
            assert r["trend"] == pytest.approx(level[r["k"]])
            assert r["remainder"] == pytest.approx(1.0 if model == "multiplicative" else 0.0)


def test_a_missing_month_breaks_the_average_where_it_is(spark):
    rows = [(month(i), 10.0) for i in range(36) if i != 20]
    df = spark.createDataFrame(rows, "month date, x double")
    got = {r["month"]: r["trend"] for r in timeseries.decompose(df, "month", "x").collect()}
    assert got[month(13)] == pytest.approx(10.0)
    assert all(got[month(i)] is None for i in range(14, 27))


def test_monthly_counts(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 1, 31), 1.0), (dt.date(2020, 1, 1), 3.0), (None, 9.0)], "d date, x double"
    )
    got = timeseries.monthly(df, "d", {"n": F.count("*"), "avg": F.avg("x")}).collect()
    assert [tuple(r) for r in got] == [(dt.date(2020, 1, 1), 2, 2.0)]
