import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimbook.operators import joins, snapshots

D = dt.date


def brute_flags(data):
    groups = {}
    for key, date, _ in data:
        if date is not None:
            groups.setdefault(key, []).append(date)
    return sorted(
        (
            key if key is not None else "~",
            str(date),
            value,
            int(date is not None and date == max(groups[key])),
            int(date is not None and date == min(groups[key])),
        )
        for key, date, value in data
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of all rows, another group is all copies."""
    rng = random.Random(3)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rng.randrange(400))
    data = [("hot", day(), i) for i in range(400)]
    data += [(f"k{rng.randrange(60)}", day(), i) for i in range(400)]
    data += [("copies", D(2020, 5, 5), 1)] * 300
    data += [(None, day(), i) for i in range(20)] + [("k1", None, 9)]
    return data, spark.createDataFrame(data, "k string, d date, v int").repartition(5)


@pytest.mark.parametrize("hot_parts", [1, 3, 64, 10_000])
def test_flags_do_not_depend_on_the_hot_share(skewed, monkeypatch, hot_parts):
    monkeypatch.setattr(joins, "HOT_PARTS", hot_parts)
    data, df = skewed
    flagged = snapshots.flag_snapshots(df, ["k"], "d")
    got = sorted(
        (r["k"] if r["k"] is not None else "~", str(r["d"]), r["v"], r["is_latest"], r["is_first"])
        for r in flagged.collect()
    )
    assert got == brute_flags(data)


def test_ties_at_the_latest_date_are_all_kept(spark):
    rows = [("c", "f1", D(2020, 2, 1)), ("c", "f2", D(2020, 2, 1)), ("c", "f3", D(2020, 1, 1))]
    df = spark.createDataFrame(rows, "claim string, feature string, at date")
    kept = snapshots.keep_latest(df, ["claim"], "at")
    assert sorted(r["feature"] for r in kept.collect()) == ["f1", "f2"]
    assert [r["feature"] for r in snapshots.keep_first(df, ["claim"], "at").collect()] == ["f3"]


@pytest.mark.parametrize("which", ["latest", "first"])
def test_totals_equal_sums_over_flagged_rows(skewed, which):
    _, df = skewed
    totals = snapshots.totals_at(
        df, ["k"], "d", {"total": F.col("v"), "n": F.lit(1)}, which
    )
    keep = snapshots.keep_latest if which == "latest" else snapshots.keep_first
    plain = keep(df, ["k"], "d").groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    def pick(table):
        return sorted((str(r["k"]), r["total"], r["n"]) for r in table.collect())

    assert pick(totals) == pick(plain)


def test_totals_plan_brings_no_raw_rows_together(skewed):
    _, df = skewed
    plan = snapshots.totals_at(df, ["k"], "d", {"n": F.lit(1)})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Join" not in text
    assert "partial_sum" in text


def test_no_task_gets_the_hot_group_after_the_join(spark):
    rows = spark.range(80_000, numPartitions=8).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"),
        (F.col("id") % 365).cast("int").alias("d"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        flagged = snapshots.flag_snapshots(rows, ["k"], "d")
        sizes = [r["count"] for r in flagged.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 80_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_rows_without_a_group_get_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    groups = spark.createDataFrame([(1, 5, "one"), (None, 1, "none")], "k int, n int, v string")
    got = sorted((str(r["k"]), r["x"], r["v"]) for r in joins.join_group_values(rows, groups, ["k"], "n").collect())
    assert got == [("1", "a", "one"), ("2", "b", None), ("None", "c", "none")]


def test_lookup_join(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    look = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    got = sorted((str(r["k"]), str(r["name"])) for r in joins.join_lookup(left, look, "k").collect())
    assert got == [("1", "a"), ("2", "b"), ("3", "None"), ("None", "None")]


def test_join_fill_keeps_the_missing_values_of_matched_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(2, None, "x", 1.5), (3, 7, None, None)], "k int, n int, s string, d double")
    got = sorted(tuple(r) for r in joins.join_fill(left, right, "k").collect())
    assert got == [(1, 0, None, 0.0), (2, None, "x", 1.5), (3, 7, None, None)]


def test_join_fill_touches_only_joined_columns(spark):
    left = spark.createDataFrame([(1, None), (2, 5.0)], "k int, credit double")
    right = spark.createDataFrame([(2, 7)], "k int, n int")
    got = sorted(tuple(r) for r in joins.join_fill(left, right, "k").collect())
    assert got == [(1, None, 0), (2, 5.0, 7)]


def test_require_unique(spark):
    good = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.require_unique(good, "k") is good
    for bad in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            joins.require_unique(spark.createDataFrame(bad, "k int"), "k")


def test_renamed_keys_are_dropped(spark):
    left = spark.createDataFrame([(2019, 1.0), (2030, 2.0)], "accident_year int, x double")
    right = spark.createDataFrame([(2019, 9.0)], "trip_year int, miles double")
    got = joins.join_keyed(left, right, {"accident_year": "trip_year"})
    assert got.columns == ["accident_year", "x", "miles"]
    assert sorted(tuple(r) for r in got.collect()) == [(2019, 1.0, 9.0), (2030, 2.0, None)]


def test_attach_reads_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).select((F.col("id") % 9).alias("k"), F.col("id").alias("x")).write.parquet(path)
    groups = spark.createDataFrame([(i, i, f"v{i}") for i in range(9)], "k long, n long, v string")
    plan = joins.join_group_values(spark.read.parquet(path), groups, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    flagged = snapshots.flag_snapshots(spark.read.parquet(path), ["k"], "x")._jdf.queryExecution().executedPlan().toString()
    # the rows, and their bounds for the largest groups and for the others, which share an exchange
    assert flagged.count("FileScan") == 3


@pytest.mark.parametrize("n_groups", [1, 63, 64, 200])
def test_attach_with_more_groups_than_are_broadcast(spark, n_groups):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % n_groups).alias("k"), F.lit("same").alias("_salt"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.concat(F.lit("v"), F.coalesce(F.col("k"), F.lit(-1))))
    got = joins.join_group_values(rows, groups, ["k"], "n")
    assert got.columns == ["k", "_salt", "v"]
    assert got.count() == 3000
    assert got.filter("v is null or v <> concat('v', coalesce(k, -1)) or _salt <> 'same'").count() == 0


def test_equal_rows_of_a_hot_group_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(40_000, numPartitions=8).select(F.lit(1).alias("k"), F.lit("x").alias("x"))
        groups = spark.createDataFrame([(1, 40_000, "v")], "k int, n int, v string")
        sizes = [r["count"] for r in joins.join_group_values(rows, groups, ["k"], "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 40_000 and max(sizes) < 40_000
