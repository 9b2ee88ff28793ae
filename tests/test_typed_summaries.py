import datetime as dt
from collections import Counter

import pytest

from claimbook.operators import quality

DAY = dt.date(2020, 1, 1)


def test_dates_are_summarised_to_whole_days(spark):
    days = [0, 1, 2, 5, 8, 100]
    rows = [(DAY + dt.timedelta(d), dt.datetime(2019, 3, 1, 23, 59), None) for d in days] + [(None, None, None)]
    got = {r["name"]: r for r in quality.summarize_dates(spark.createDataFrame(rows, "a date, `b c` timestamp_ntz, z date"), ["a", "b c", "z"]).collect()}
    at = lambda d: DAY + dt.timedelta(d)
    # quartiles at 1.25, 3.5 and 7.25 days, mean 19.33
    assert tuple(got["a"])[1:] == (at(0), at(1), at(3), at(19), at(7), at(100), 1)
    assert got["b c"]["median"] == dt.date(2019, 3, 1) and got["b c"]["n_null"] == 1
    assert got["z"]["min"] is None and got["z"]["median"] is None and got["z"]["n_null"] == 7


def test_dates_before_the_epoch(spark):
    rows = [(dt.date(1969, 12, 30),), (dt.date(1969, 12, 31),)]
    got = quality.summarize_dates(spark.createDataFrame(rows, "a date"), ["a"]).first()
    assert (got["min"], got["median"], got["max"]) == (dt.date(1969, 12, 30), dt.date(1969, 12, 30), dt.date(1969, 12, 31))


@pytest.mark.parametrize("top", [1, 3, 50])
def test_levels_are_counted_exactly(spark, top):
    rows = [(f"t{i * i % 17}" if i % 5 else None, i % 3 == 0, "same", None) for i in range(400)]
    table = quality.summarize_levels(spark.createDataFrame(rows, "t string, f boolean, s string, z string").repartition(5), ["t", "f", "s", "z"], top)
    got = {}
    for r in table.collect():
        got.setdefault(r["name"], []).append(tuple(r)[1:])
    for j, name in enumerate("tfs"):
        values = [str(r[j]).lower() if name == "f" else r[j] for r in rows if r[j] is not None]
        order = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))
        want = [(i + 1, v, n, pytest.approx(n / len(values)), len(order), 400 - len(values)) for i, (v, n) in enumerate(order[:top])]
        assert sorted(got[name]) == want
    assert "z" not in got


def test_only_the_top_levels_are_sorted_together(spark):
    wide = spark.range(1000).selectExpr("cast(id as string) as a")
    plan = quality.summarize_levels(wide, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
