"""Categories of many levels, and feature tables kept in buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimbook.operators import glm, levels
from claimbook.plans.households import merge_counted
from claimbook.sources import bucketed
from claimbook.sources.scratch import shared_folder


def _sample(spark, n=6000, n_levels=12, hot=0.4, seed=3):
    rng = np.random.default_rng(seed)
    level = np.where(rng.random(n) < hot, 0, rng.integers(0, n_levels, n))
    a, b = rng.normal(50, 2, n), rng.normal(size=n)
    eta = -0.4 + 0.3 * (a - 50) - 0.7 * b + np.sin(level)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    data = [(f"z{k:03d}", float(u), float(w), int(t)) for k, u, w, t in zip(level, a, b, y)]
    return spark.createDataFrame(data, "zip string, a double, b double, y int")


def test_levels_are_numbered_by_value(spark):
    values = ["b", None, "a", "c", "a", "é", "", "a"]
    df = spark.createDataFrame([(x,) for x in values], "zip string")
    got = [tuple(r) for r in levels.index_levels(df, "zip").orderBy("position").collect()]
    assert got == [("", 0, 1), ("a", 1, 3), ("b", 2, 1), ("c", 3, 1), ("é", 4, 1)]
    assert levels.index_levels(df.limit(0), "zip").count() == 0


def test_fit_equals_the_fit_with_one_term_per_level(spark):
    df = _sample(spark)
    ours = levels.fit_levels(df, "y", "zip", ["a", "b"])
    full = glm.fit_glm(df, "y", ["a", "b", "zip"], {"zip": "z000"}, tol=1e-12)
    assert ours.converged
    for r in levels.term_table(spark, ours).collect():
        assert r["estimate"] == pytest.approx(full.coefficients[r["term"]], abs=1e-7)
        assert r["std_error"] == pytest.approx(full.std_errors[r["term"]], rel=1e-5)
        assert r["p_value"] == pytest.approx(full.p_values[r["term"]], abs=1e-6)
    rows = {r["level"]: r for r in levels.level_table(ours, "z000").collect()}
    assert len(rows) == 12 and rows["z000"]["estimate"] == 0.0 and rows["z000"]["std_error"] is None
    for name, r in rows.items():
        if name != "z000":
            assert r["estimate"] == pytest.approx(full.coefficients["zip" + name], abs=1e-7)
            assert r["std_error"] == pytest.approx(full.std_errors["zip" + name], rel=1e-5)
    pair = levels.predicted(df, ours).withColumn("full", full.probability())
    assert pair.filter(F.abs(F.col("probability") - F.col("full")) > 1e-7).count() == 0


def test_separated_levels_missing_values_and_aliased_terms(spark):
    df = _sample(spark, 3000).withColumn("of_zip", (F.col("zip") > "z005").cast("int")).withColumn("twice", F.col("b") * 2)
    odd = spark.createDataFrame(
        [("all", 1.0, 1.0, 1, 0, 2.0)] * 3 + [("none", 1.0, 1.0, 0, 0, 2.0), (None, 1.0, 1.0, 1, 0, 2.0),
                                              ("z001", None, 1.0, 1, 0, 2.0)], df.schema)
    plain = levels.fit_levels(df, "y", "zip", ["b"])
    ours = levels.fit_levels(df.union(odd), "y", "zip", ["b", "of_zip", "twice"])
    assert ours.kept == ("b",) and ours.aliased == ("of_zip", "twice")
    assert ours.estimates["b"] == pytest.approx(levels.fit_levels(
        df.union(odd.filter("a is null")), "y", "zip", ["b"]).estimates["b"], abs=1e-8)
    assert ours.n_rows == 3005 and plain.n_rows == 3000
    rows = {r["level"]: r for r in levels.level_table(ours, "z000").collect()}
    assert rows["all"]["separated"] and rows["none"]["separated"] and rows["all"]["estimate"] is None
    fresh = spark.createDataFrame([("all", 0.0), ("none", 0.0), ("new", 0.0), (None, 0.0), ("z001", None)], "zip string, b double")
    got = {(r["zip"], r["b"]): r["probability"] for r in levels.predicted(fresh, ours).collect()}
    assert got == {("all", 0.0): 1.0, ("none", 0.0): 0.0, ("new", 0.0): None, (None, 0.0): None, ("z001", None): None}
    with pytest.raises(ValueError):
        levels.level_table(ours, "all")
    with pytest.raises(ValueError):
        levels.fit_levels(df.limit(0), "y", "zip", ["b"])


def test_a_hundred_thousand_levels(spark):
    n_levels = 100_000
    df = spark.range(n_levels * 4).select(
        F.concat(F.lit("k"), (F.col("id") % n_levels).cast("string")).alias("zip"),
        (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") / n_levels >= 1 + F.col("id") % 3).cast("int").alias("y"))
    model = levels.fit_levels(df, "y", "zip", ["x"], max_iter=15)
    assert model.effects.count() == n_levels and model.converged
    assert model.effects.filter("separated").count() == 0
    # the likelihood equations hold: fitted and observed positives agree in every level
    fitted = levels.predicted(df, model).groupBy("zip").agg((F.sum("y") - F.sum("probability")).alias("d"))
    assert fitted.agg(F.max(F.abs("d"))).first()[0] < 1e-4


def test_bucketed_tables_join_without_moving_rows(spark):
    base = spark.range(500).withColumnRenamed("id", "hhld_id")
    predictors = base.withColumn("age", F.col("hhld_id") % 60)
    counts = base.filter("hhld_id % 3 = 0").withColumn("claims", F.lit(2))
    outcomes = base.filter("hhld_id % 5 <> 0").withColumn("loss", F.col("hhld_id") * 1.5)
    plain = merge_counted(predictors, counts, outcomes)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = ("b_predictors", "b_counts", "b_outcomes")
    try:
        stored = [bucketed.write_bucketed(t, n, "hhld_id", 8) for n, t in zip(names, (predictors, counts, outcomes))]
        merged = merge_counted(*stored)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, plain.collect()))

        path = bucketed.location(spark, "b_predictors")
        spark.sql("DROP TABLE b_predictors")
        again = bucketed.open_bucketed(spark, "b_predictors", path, "hhld_id BIGINT, age BIGINT", "hhld_id", 8)
        merged = merge_counted(again, *stored[1:])
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for n in names:
            bucketed.drop_bucketed(spark, n)
    assert not [t for t in spark.catalog.listTables() if t.name in names]


def test_fit_leaves_one_table(spark):
    root = shared_folder(spark).rsplit("/", 1)[0]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def count():
        return len(files.listStatus(fs)) if files.exists(fs) else 0

    before = count()
    levels.fit_levels(_sample(spark, 500), "y", "zip", ["b"])
    assert count() == before + 1
