"""Merged states against totals over all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimbook.operators import snapshot_state as st
from claimbook.operators.snapshots import totals_at
from claimbook.plans import reinsurance as re

DDL = "claim string, part int, at date, paid double, n int"


@pytest.fixture(scope="module")
def measures(spark):
    return {"paid": F.col("paid"), "rows": F.lit(1), "n": F.col("n")}



def some_rows(seed, n=400):
    rng = random.Random(seed)
    day = dt.date(2020, 1, 1)
    return [
        (rng.choice([None, "a", "b", "c", "hot", "hot", "hot"]), rng.choice([None, 1, 2]),
         rng.choice([None, *[day + dt.timedelta(30 * i) for i in range(6)]]), rng.choice([None, 1.0, 2.5, 4.0]), rng.choice([None, 3]))
        for _ in range(n)
    ]


def shown(df):
    return sorted(map(str, df.select("claim", "part", "at", "paid", "rows", "n").collect()))


@pytest.mark.parametrize("which", st.ENDS)
@pytest.mark.parametrize("sizes", [(400, 1), (3, 300), (0, 40), (40, 0), (0, 0)])
def test_merged_state_equals_all_rows(spark, measures, which, sizes):
    a, b = (spark.createDataFrame(some_rows(i, n), DDL) for i, n in enumerate(sizes))
    keys = ["claim", "part"]
    merged = st.merge_states(*[st.snapshot_state(x, keys, "at", measures) for x in (a, b)], keys)
    got = st.state_totals(merged, keys, "at", list(measures), which)
    assert shown(got) == shown(totals_at(a.union(b), keys, "at", measures, which))
    assert (merged.agg(F.sum("n_rows")).first()[0] or 0) == a.union(b).filter("at is not null").count()


def test_store_adds_runs_one_after_another(spark, measures, tmp_path):
    store = st.SnapshotStore(spark, str(tmp_path / "state"), ["claim", "part"], "at", measures)
    assert store.state() is None and store.runs() == []
    with pytest.raises(ValueError):
        store.totals()
    runs = [spark.createDataFrame(some_rows(10 + i, 90), DDL) for i in range(3)]
    for i, run in enumerate(runs):
        store.add(f"2022-0{i + 1}", run)
    everything = runs[0].union(runs[1]).union(runs[2])
    for which in st.ENDS:
        assert shown(store.totals(which)) == shown(totals_at(everything, ["claim", "part"], "at", measures, which))
    with pytest.raises(ValueError):
        store.add("2022-02", runs[1])
    assert [r for _, r in store.runs()] == ["2022-01", "2022-02", "2022-03"]
    before = shown(store.totals())
    store.forget_old()
    assert shown(store.totals()) == before
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")) == ["log", "v3"]


def test_a_failed_attempt_leaves_the_last_version(spark, measures, tmp_path):
    store = st.SnapshotStore(spark, str(tmp_path / "state"), ["claim", "part"], "at", measures)
    first = spark.createDataFrame(some_rows(1, 50), DDL)
    store.add("one", first)
    # what a writer leaves that died before its entry in the log
    first.write.parquet(str(tmp_path / "state" / "v2"))
    assert shown(store.totals()) == shown(totals_at(first, ["claim", "part"], "at", measures))
    second = spark.createDataFrame(some_rows(2, 50), DDL)
    store.add("two", second)
    assert shown(store.totals()) == shown(totals_at(first.union(second), ["claim", "part"], "at", measures))


def test_merging_reads_no_old_run(spark, measures, tmp_path):
    store = st.SnapshotStore(spark, str(tmp_path / "state"), ["claim", "part"], "at", measures)
    old = str(tmp_path / "earlier")
    spark.createDataFrame(some_rows(1, 50), DDL).write.parquet(old)
    store.add("one", spark.read.parquet(old))
    fresh = st.snapshot_state(spark.createDataFrame(some_rows(2, 50), DDL), ["claim", "part"], "at", measures)
    merged = st.merge_states(store.state(), fresh, ["claim", "part"])
    assert all("/earlier/" not in f for f in merged.inputFiles())


def test_diagonal_of_a_store_equals_the_diagonal_of_all_rows(spark, tmp_path):
    rng, day = random.Random(3), dt.date(2019, 5, 17)
    rows = [(f"c{rng.randrange(30)}", "x", rng.choice(["BI", "PD"]), day + dt.timedelta(rng.randrange(3)), "p",
             day + dt.timedelta(40 * rng.randrange(1, 30)), 1000.0 * rng.randrange(900), 5000.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "claim_number string, claimant_name string, coverage string, loss_date date, period string,"
                                     "evaluation_date date, paid_loss double, reserve_loss double")
    valued = re.value_losses(df, *re.PRIMARY_LAYER)
    for rule in ("rows", "ceded"):
        store = re.diagonal_store(spark, str(tmp_path / rule), count_rule=rule)
        for i in range(2):
            store.add(str(i), valued.filter(F.col("paid_loss") % 2000 == 1000 * i))
        want = re.latest_diagonal(valued, count_rule=rule)
        assert sorted(map(str, re.diagonal_table(store.totals()).collect())) == sorted(map(str, want.collect()))
