import datetime as dt

from claimbook.sources import rejects, schemas, tables

GOOD = ["1,3/9/2015,10.5,1", "2,12/31/2016,,0", "3,1/1/2017,1e3,"]
BAD = {
    "x,3/9/2015,1.0,1": "hhld_id: not BIGINT",
    "5,31/31/2015,n/a,1": "clm_dates: not DATE; pd_amt: not DOUBLE",
    "6,3/9/2015,1.0,1.5": "aft_ind: not INT",
    "7,3/9/2015,1.0": "cells",
    "8,3/9/2015,1.0,1,9": "cells",
    ",3/9/2015,2.0,1": "hhld_id: missing",
}
HEADER = "hhld_id,clm_dates,pd_amt,aft_ind\n"


def test_planted_faults_come_back_with_their_reason(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = GOOD + list(BAD)
    (tmp_path / "in" / "a.csv").write_text(HEADER + "\n".join(lines[::2]) + "\n")
    (tmp_path / "in" / "b.csv").write_text(HEADER + "\n".join(lines[1::2]) + "\n")
    got = rejects.read_checked(spark, str(tmp_path / "in"), schemas.CLAIMS, required=["hhld_id"])
    rejected = got.rejected.collect()
    assert {r["line"]: r["reason"] for r in rejected} == BAD
    assert all(r["n_problems"] == 1 + r["reason"].count(";") for r in rejected)
    for r in rejected:
        assert r["file"].endswith("a.csv" if r["line"] in lines[::2] else "b.csv")
    (tmp_path / "good.csv").write_text(HEADER + "\n".join(GOOD) + "\n")
    want = tables.read_table(spark, str(tmp_path / "good.csv"), schemas.CLAIMS)
    assert got.kept.schema.simpleString() == want.schema.simpleString()
    assert set(map(tuple, got.kept.collect())) == set(map(tuple, want.collect()))
    counts = {r["reason"]: r["n_rows"] for r in got.problems().collect()}
    assert counts["cells"] == 2 and counts["pd_amt: not DOUBLE"] == 1


def test_nothing_wrong_and_nothing_there(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '1,3/9/2015,"1.0",1\n')
    got = rejects.read_checked(spark, str(tmp_path / "a.csv"), schemas.CLAIMS)
    assert [tuple(r) for r in got.kept.collect()] == [(1, dt.date(2015, 3, 9), 1.0, 1)]
    assert got.rejected.collect() == []
    (tmp_path / "b.csv").write_text(HEADER)
    empty = rejects.read_checked(spark, str(tmp_path / "b.csv"), schemas.CLAIMS)
    assert empty.kept.collect() == empty.rejected.collect() == []
