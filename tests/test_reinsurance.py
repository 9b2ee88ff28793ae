import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimbook.plans import reinsurance as re

D = dt.date


@pytest.fixture(scope="module")
def primary(spark):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        loss = D(2018 + c % 4, 1 + c % 12, 1 + c % 28)
        n = 150 if c == 0 else 6  # one claim holds a large share of all snapshots
        for i in range(n):
            rows.append(
                (f"c{c}", f"p{i % 2}", "BI" if c % 2 else "PD", "Transporting Rider", f"f{i % 3}",
                 loss, loss + dt.timedelta(days=30 * rng.randrange(1, 30)),
                 float(rng.randrange(0, 900_000)), float(rng.randrange(0, 100_000)))
            )
    return spark.createDataFrame(
        rows,
        "claim_number string, claimant_name string, coverage string, period string,"
        "feature_identifier string, loss_date date, evaluation_date date,"
        "paid_loss double, reserve_loss double",
    ).repartition(4)


@pytest.fixture(scope="module")
def excess(spark):
    rows = [
        ("e1", D(2020, 1, 1), D(2020, 3, 1), 600_000.0, 0.0, "Transporting Rider"),
        ("e1", D(2020, 1, 1), D(2021, 3, 1), 400_000.0, 50_000.0, "Transporting Rider"),
        ("e2", D(2020, 9, 1), D(2020, 6, 30), 100.0, None, "En Route To Pickup"),
        ("e2", D(2020, 9, 1), D(2021, 6, 30), 100.0, 5.0, "En Route To Pickup"),
        ("e3", D(2019, 1, 1), D(2019, 2, 1), -50.0, 0.0, "Available"),
    ]
    ddl = (
        "`Claim Number` string, `Loss Date` date, `Evaluation Date` date,"
        "`Paid Loss` double, `Reserve Loss` double, `Period` string"
    )
    return spark.createDataFrame(rows, ddl)


def flagged_diagonal(run, by):
    latest = re.develop(run).filter("is_latest = 1")
    return sorted(
        tuple(r)
        for r in latest.groupBy(*by)
        .agg(F.round(F.sum("incurred_loss"), 4), F.round(F.sum("ceded_loss"), 4), F.count("*"))
        .collect()
    )


@pytest.mark.parametrize("by", [["accident_year", "maturity_bucket"], ["coverage"], ["accident_year"]])
def test_diagonal_equals_the_flagged_rows(primary, by):
    table = re.latest_diagonal(re.value_losses(primary, *re.PRIMARY_LAYER), by=by)
    got = sorted(
        tuple(r)
        for r in table.select(
            *by, F.round("total_incurred", 4), F.round("total_ceded", 4), "claim_count"
        ).collect()
    )
    assert got == flagged_diagonal(primary, by)


def test_a_breakdown_finer_than_the_keys_is_refused(primary):
    with pytest.raises(ValueError):
        re.latest_diagonal(
            re.value_losses(primary, *re.PRIMARY_LAYER), by=["feature_identifier"]
        )


def test_splitting_a_run_and_combining_gives_the_whole(primary):
    valued = re.value_losses(primary, *re.PRIMARY_LAYER)
    half = F.col("coverage") == "BI"
    whole = re.combine_runs(re.latest_diagonal(valued, count_rule="ceded"))
    parts = re.combine_runs(
        re.latest_diagonal(valued.filter(half), count_rule="ceded"),
        re.latest_diagonal(valued.filter(~half), count_rule="ceded"),
    )
    def pick(d):
        return sorted(
            (r["accident_year"], r["maturity_bucket"], round(r["total_ceded"], 4), r["claim_count"])
            for r in d.collect()
        )

    assert pick(whole) == pick(parts) and len(pick(whole)) > 0


def test_doubling_every_row_doubles_sums(primary):
    valued = re.value_losses(primary, *re.PRIMARY_LAYER)
    once = {r["coverage"]: r for r in re.latest_diagonal(valued, by=["coverage"]).collect()}
    twice = re.latest_diagonal(valued.union(valued), by=["coverage"]).collect()
    for r in twice:
        assert r["claim_count"] == 2 * once[r["coverage"]]["claim_count"]
        assert r["total_incurred"] == pytest.approx(2 * once[r["coverage"]]["total_incurred"])


def test_excess_layer_and_counts(excess):
    run = re.value_losses(re.clean_excess_names(excess), *re.EXCESS_LAYER, floor_at_zero=False)
    got = {(r["claim_number"], str(r["evaluation_date"])): r["ceded_loss"] for r in run.collect()}
    assert got["e1", "2020-03-01"] == 500_000.0
    assert got["e1", "2021-03-01"] == 450_000.0
    assert got["e2", "2020-06-30"] is None
    assert got["e3", "2019-02-01"] == -50.0


def test_corrections_move_the_loss_date_before_grouping(excess):
    run = re.clean_excess_names(excess)
    fixes = re.suggest_corrections(run)
    assert [tuple(r) for r in fixes.collect()] == [("e2", D(2020, 1, 30))]
    fixed = re.correct_dates(run, fixes).filter("claim_number = 'e2'")
    assert {r["loss_date"] for r in fixed.collect()} == {D(2020, 1, 30)}
    unchanged = re.correct_dates(run, fixes).filter("claim_number = 'e1'").first()
    assert unchanged["loss_date"] == D(2020, 1, 1)


def test_corrections_from_a_mapping(spark, excess):
    fixes = re.corrections_table(spark, {"e2": D(2020, 2, 2)})
    fixed = re.correct_dates(re.clean_excess_names(excess), fixes)
    assert fixed.filter("claim_number = 'e2'").first()["loss_date"] == D(2020, 2, 2)


def test_report_lag_leaves_negative_ages_out(excess):
    run = re.value_losses(re.clean_excess_names(excess), *re.EXCESS_LAYER)
    got = {r["period"]: (r["avg_maturity"], r["n_rows"]) for r in re.report_lag(run).collect()}
    assert got == {"Transporting Rider": (2.0, 1), "Available": (pytest.approx(31 / 30, abs=1e-4), 1)}


def test_covered_periods(excess):
    kept = re.covered(re.clean_excess_names(excess))
    assert {r["period"] for r in kept.collect()} == {"Transporting Rider", "En Route To Pickup"}


def test_unknown_claimants_count_once(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", None), ("a", None), ("b", "x")], "claim_number string, claimant_name string"
    )
    assert sorted(tuple(r) for r in re.claimants(df).collect()) == [("a", 2), ("b", 1)]


@pytest.fixture(scope="module")
def trips(spark):
    t = dt.datetime(2019, 6, 1, 7, 0)
    m = dt.timedelta(minutes=1)
    rows = [
        ("1", "23", "v", "completed", "P2P", t, t + 30 * m, 10.0, 5.0),
        ("12", "3", "v", "completed", "Eats", t, t, 2.0, 5.0),
        ("4", "d", "v", "completed", "Eats", t, t, 0.0, 5.0),
        ("5", "d", "v", "canceled", "P2P", t, t, 1.0, 5.0),
        ("6", "d", "v", "completed", "\\N", t, t, 1.0, 5.0),
        ("7", "d", "v", "completed", "P2P", None, None, None, 5.0),
        ("8", "d", "v", "completed", "P2P", t, t + 3 * m, 5.0, 5.0),
    ]
    names = [*re.TRIP_IDS, *re.TRIP_NAMES]
    kinds = ["string"] * 5 + ["timestamp_ntz"] * 2 + ["double"] * 2
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def test_clean_trips(trips):
    got = {r["trip_key"]: r for r in re.clean_trips(trips).collect()}
    assert set(got) == {"1|23|v", "12|3|v", "4|d|v", "8|d|v"}
    assert got["1|23|v"]["trip_minutes"] == 30.0


def test_speed_screen(trips):
    found = [r["trip_key"] for r in re.speed_screen(re.clean_trips(trips)).collect()]
    assert found == ["12|3|v", "8|d|v"]  # instant trip first, then 100 mph
    softened = [r["trip_key"] for r in re.speed_screen(re.clean_trips(trips), 80, 0.5).collect()]
    assert softened == ["12|3|v", "8|d|v"]


def test_exposure_and_loss_cost(spark, trips):
    miles = re.exposure(re.clean_trips(trips))
    assert [tuple(r) for r in miles.collect()] == [(2019, 17.0, 4, 1)]
    losses = spark.createDataFrame(
        [(2019, "1y", 34.0, 2), (2018, "1y", 5.0, 1)],
        "accident_year int, maturity_bucket string, total_ceded double, claim_count bigint",
    )
    got = {r["accident_year"]: r for r in re.loss_cost(losses, miles).collect()}
    assert got[2019]["ceded_loss_cost"] == 2.0 and got[2019]["ceded_frequency"] == 2 / 17
    assert got[2018]["ceded_loss_cost"] is None and got[2018]["total_miles"] is None
    valued = re.loss_cost(losses.drop("maturity_bucket"), miles, 2022).collect()
    assert {r["accident_year"]: r["maturity"] for r in valued} == {2019: 3, 2018: 4}


def test_bucket_rank_orders_buckets(primary):
    ranked = re.with_bucket_rank(re.value_losses(primary, *re.PRIMARY_LAYER))
    assert ranked.filter("bucket_rank is null").count() == 0
