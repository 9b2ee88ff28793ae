import datetime as dt

import pytest

from claimbook.sources import schemas, tables
from claimbook.sources.scratch import shared_folder


def test_delimited_scan_uses_declared_types(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text("hhld_id,clm_dates,pd_amt,aft_ind\n1,3/9/2015,10.5,1\n2,12/31/2016,,0\n")
    df = tables.read_table(spark, str(path), schemas.CLAIMS)
    assert [tuple(r) for r in df.orderBy("hhld_id").collect()] == [
        (1, dt.date(2015, 3, 9), 10.5, 1),
        (2, dt.date(2016, 12, 31), None, 0),
    ]


def test_columns_follow_the_header_not_the_position(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text("hhld_id,clm_dates,pd_amt,aft_ind\n7,1/1/2015,1.0,1\n")
    with pytest.raises(Exception):
        other = schemas.T.StructType(list(reversed(schemas.CLAIMS.fields)))
        tables.read_table(spark, str(path), other).collect()


def test_delimited_scan_needs_a_schema(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.csv")


def test_bad_dates_become_null(spark):
    texts = ["4/3/2020 7:05", "13/45/2020 1:00", "nonsense", None]
    df = spark.createDataFrame([(t, t) for t in texts], "a string, b string")
    parsed = tables.parse_dates(
        df, {"a": schemas.DATE_TIME_PATTERN, "b": schemas.DATE_TIME_PATTERN}, keep_time=["b"]
    )
    assert dict(parsed.dtypes) == {"a": "date", "b": "timestamp_ntz"}
    got = [tuple(r) for r in parsed.collect()]
    assert got[0] == (dt.date(2020, 4, 3), dt.datetime(2020, 4, 3, 7, 5))
    assert got[1:] == [(None, None)] * 3


def test_dotted_and_blank_names_survive(spark, tmp_path):
    path = tmp_path / "trips.csv"
    names = [f.name for f in schemas.TRIPS.fields]
    path.write_text(",".join(names) + "\nt,d,v,completed,\\N,4/3/2020 7:05,4/3/2020 7:25,1.5,9\n")
    df = tables.read_table(spark, str(path), schemas.TRIPS)
    row = df.first()
    assert row["b.risk_segment"] == "\\N"
    assert row["c.distance_miles_p3"] == 1.5


def test_parquet_round_trip_keeps_types(spark):
    path = shared_folder(spark)
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), None)], "a int, b date, c double")
    tables.write_table(df, path)
    back = tables.read_table(spark, path)
    assert back.dtypes == df.dtypes
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_shared_folder_follows_the_session_setting(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(root)
