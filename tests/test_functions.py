import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimbook.functions import actuarial as act
from claimbook.functions import semantics as sem


def one(spark, ddl, row, column):
    return spark.createDataFrame([row], ddl).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "num, den, want", [(1.0, 4.0, 0.25), (1.0, 0.0, None), (0.0, 0.0, None), (None, 2.0, None)]
)
def test_safe_div(spark, num, den, want):
    assert one(spark, "a double, b double", (num, den), sem.safe_div("a", "b")) == want


@pytest.mark.parametrize("value, want", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (-0.5, 0.0)])
def test_round_half_to_even(spark, value, want):
    assert one(spark, "a double", (value,), sem.round_even("a", 0)) == want


def test_extremes_propagate_null(spark):
    assert one(spark, "a double", (None,), sem.max_of("a", 0.0)) is None
    assert one(spark, "a double", (-3.0,), sem.max_of("a", 0.0)) == 0.0
    assert one(spark, "a double", (5.0,), sem.min_of("a", 2.0)) == 2.0


def test_nan_never_passes_a_filter(spark):
    df = spark.createDataFrame([(float("nan"),), (100.0,)], "a double")
    assert df.filter(sem.finite("a") > 80).count() == 1


def test_composite_keys_do_not_collide(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "x")], "a string, b string")
    keys = [r[0] for r in df.select(sem.composite_key("a", "b")).collect()]
    assert keys == ["1|23", "12|3", "NA|x"]


@pytest.mark.parametrize(
    "value, want", [("123", "00123"), ("12345", "12345"), ("123456", "123456"), (None, None)]
)
def test_pad_zero_never_truncates(spark, value, want):
    assert one(spark, "a string", (value,), sem.pad_zero("a", 5)) == want


def test_distinct_count_with_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "a string")
    plain, with_null = df.agg(
        sem.distinct_count("a"), sem.distinct_count("a", count_null=True)
    ).first()
    assert (plain, with_null) == (1, 2)


def test_level_rank_and_membership(spark):
    df = spark.createDataFrame([("2y",), ("zz",), (None,)], "a string")
    got = df.select(
        sem.level_rank("a", act.MATURITY_LEVELS), sem.in_levels("a", ["2y"])
    ).collect()
    assert [tuple(r) for r in got] == [(5, "2y"), (None, None), (None, None)]


def test_sort_puts_nulls_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "a int")
    assert [r[0] for r in df.orderBy(*sem.ascending("a")).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(*sem.descending("a")).collect()] == [2, 1, None]


@pytest.mark.parametrize(
    "incurred, ceded, flag",
    [
        (250_000.0, 0.0, 0),
        (250_000.01, 0.01, 1),
        (1_500_000.0, 1_250_000.0, 1),
        (2_000_000.0, 1_250_000.0, 1),
        (None, None, None),
        (-5.0, 0.0, 0),
    ],
)
def test_layer_and_trigger(spark, incurred, ceded, flag):
    got = one(spark, "a double", (incurred,), act.layer("a", 250_000, 1_250_000))
    assert got == pytest.approx(ceded) if ceded is not None else got is None
    assert one(spark, "a double", (incurred,), act.exceeds("a", 250_000)) == flag


def test_layer_may_stay_negative(spark):
    assert one(spark, "a double", (-5.0,), act.layer("a", 0, 500_000, floor_at_zero=False)) == -5.0


@pytest.mark.parametrize(
    "months, want",
    [
        (3.0, "3m"), (3.0333, "6m"), (6.0, "6m"), (6.0333, "9m"), (9.0, "9m"), (9.0333, "1y"),
        (12.0, "1y"), (12.0333, "2y"), (24.0, "2y"), (24.0333, "3y"), (36.0, "3y"),
        (36.0333, "4y"), (48.0, "4y"), (48.0333, "4y+"), (-1.0, "3m"), (None, None),
    ],
)
def test_maturity_buckets(spark, months, want):
    assert one(spark, "a double", (months,), act.maturity_bucket("a")) == want


def test_unknown_maturity_can_go_to_the_open_bucket(spark):
    assert one(spark, "a double", (None,), act.maturity_bucket("a", null_to_open=True)) == "4y+"


def test_maturity_is_in_30_day_months(spark):
    row = (dt.date(2020, 1, 1), dt.date(2020, 4, 1))
    got = one(spark, "a date, b date", row, act.maturity("a", "b"))
    assert got == pytest.approx(91 / 30, abs=5e-5)


@pytest.mark.parametrize(
    "name, exact, pattern",
    [
        ("MISSING", "Missing", "Missing"),
        ("missing", "Major_Insurer", "Missing"),
        ("OTHER", "Minor_Insurer", "Minor_Insurer"),
        ("ACME", "Major_Insurer", "Major_Insurer"),
        (None, None, None),
    ],
)
def test_insurer_buckets(spark, name, exact, pattern):
    assert one(spark, "a string", (name,), act.insurer_bucket("a")) == exact
    assert one(spark, "a string", (name,), act.insurer_bucket("a", pattern=True)) == pattern


def test_null_insurer_can_count_as_major(spark):
    got = one(spark, "a string", (None,), act.insurer_bucket("a", null_to_major=True))
    assert got == "Major_Insurer"


@pytest.mark.parametrize(
    "date, want",
    [
        (dt.date(2016, 12, 31), "< 1 yr"), (dt.date(2015, 1, 1), "1-3 yrs"),
        (dt.date(2014, 6, 1), "1-3 yrs"), (dt.date(2012, 1, 1), "3-5 yrs"),
        (dt.date(2011, 12, 31), "5+ yrs"), (None, None),
    ],
)
def test_years_ago(spark, date, want):
    assert one(spark, "a date", (date,), act.years_ago_bucket("a", dt.date(2017, 1, 1))) == want


def test_minutes_and_speed(spark):
    start, end = dt.datetime(2020, 1, 1, 7, 0), dt.datetime(2020, 1, 1, 7, 30)
    df = spark.createDataFrame([(start, end)], "s timestamp_ntz, e timestamp_ntz")
    minutes = act.minutes_between("s", "e")
    got = df.select(minutes, act.average_speed(F.lit(10.0), minutes)).first()
    assert tuple(got) == (30.0, 20.0)
    assert one(spark, "m double", (0.0,), act.average_speed(F.lit(1.0), "m")) is None
    assert one(spark, "m double", (0.0,), act.average_speed(F.lit(1.0), "m", 0.5)) == 120.0


def test_minutes_do_not_follow_clock_changes(spark):
    df = spark.createDataFrame([("2021-03-14 01:30:00", "2021-03-14 03:30:00"), (None, "2021-03-14 03:30:00")], "a string, b string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.selectExpr("cast(a as timestamp_ntz) a", "cast(b as timestamp_ntz) b").select(
            act.minutes_between("a", "b")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [120.0, None]
