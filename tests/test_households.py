import datetime as dt

import pytest

from claimbook.plans import households as hh

D = dt.date
AS_OF = D(2017, 1, 1)


@pytest.fixture(scope="module")
def claims(spark):
    rows = [
        (1, D(2016, 12, 31), 10.0, 1),
        (1, D(2016, 1, 1), 5.0, 1),
        (1, D(2014, 5, 5), 7.0, 0),
        (2, D(2017, 1, 1), 99.0, 1),  # on the as-of date: out
        (3, D(2010, 6, 6), 4.0, 0),  # before the five-year look-back
        (4, D(2012, 1, 1), 3.0, 1),  # first day of the look-back
        (4, D(2011, 12, 31), 2.0, 1),
    ]
    return spark.createDataFrame(rows, "hhld_id bigint, clm_dates date, pd_amt double, aft_ind int")


@pytest.fixture(scope="module")
def predictors(spark):
    ddl = (
        "hhld_id bigint, zipcode string, curnt_insurer string, inforce_ind int, prior_bi double,"
        "time_w_carr double, credit_score double, veh_cnt int, veh_own_cnt int, veh_lease_cnt int,"
        "veh_lien_cnt int, hoh_married boolean, curnt_bi_low int, curnt_bi_upp int"
    )
    rows = [
        (1, "123", "MISSING", 0, None, None, None, 3, 1, 1, None, True, 25, 25),
        (2, "12345", "OTHER", 1, 50000.0, 2.0, 700.0, 2, 2, 0, 0, False, 50, 50),
        (3, "123456", "ACME", 1, 7.0, 1.0, 601.0, 1, 0, 0, 1, None, 100, 100),
        (5, None, "ACME", 1, 25000.0, 1.0, 600.0, 1, 1, 0, None, True, 999, 999),
    ]
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(1, 0.0, 100.0, 0.0, 0), (2, 50.0, 100.0, 0.5, 1), (9, 1.0, 1.0, 1.0, 1)]
    return spark.createDataFrame(
        rows, "hhld_id bigint, loss_amount double, premium double, loss_ratio double, future_clm_ind int"
    )


def by_id(df):
    return {r["hhld_id"]: r.asDict() for r in df.collect()}


def test_paid_history_by_bucket(claims):
    got = by_id(hh.paid_history(claims, AS_OF))
    assert set(got) == {1, 3, 4}
    assert got[1]["paid_0_1y_at_fault"] == 15.0
    assert got[1]["paid_1_3y_not_at_fault"] == 7.0
    assert got[3]["paid_5y_plus_not_at_fault"] == 4.0
    assert got[4]["paid_3_5y_at_fault"] == 3.0 and got[4]["paid_5y_plus_at_fault"] == 2.0
    assert got[4]["paid_0_1y_at_fault"] == 0.0


def test_original_column_names(claims):
    assert "< 1 yr__nf" in hh.paid_history(claims, AS_OF, clean_names=False).columns
    assert hh.claim_counts(claims, AS_OF, clean_names=False).columns[1:3] == ["2012__f", "2012__nf"]
    assert hh.paid_totals(claims, AS_OF, clean_names=False).columns[1:] == ["Paid_Amt_f", "Paid_Amt_nf"]


def test_claim_counts_over_the_look_back(claims):
    got = by_id(hh.claim_counts(claims, AS_OF))
    assert set(got) == {1, 4}
    assert got[1]["claims_2016_at_fault"] == 2 and got[1]["claims_2014_not_at_fault"] == 1
    assert got[4]["claims_2012_at_fault"] == 1
    assert len(got[1]) == 11


def test_imputation(predictors):
    got = by_id(hh.impute_predictors(predictors))
    assert got[1]["veh_lien_cnt"] == 1 and got[5]["veh_lien_cnt"] == 0
    assert got[1]["prior_bi"] == 0.0 and got[1]["time_w_carr"] == 0.0
    assert got[1]["credit_score"] == 634.0  # mean of 700, 601, 600 rounded
    assert got[3]["credit_score"] == 601.0


def test_clean_predictors(predictors):
    clean = hh.clean_predictors(predictors)
    assert not {"zipcode", "curnt_insurer", "curnt_bi_low", "hoh_married"} & set(clean.columns)
    got = by_id(clean)
    assert got[2]["curnt_bi"] == 50000
    assert [got[i]["hoh_married_ind"] for i in (1, 2, 3)] == [1, 0, None]
    flags = ("prior_insurer_major", "prior_insurer_minor", "prior_insurer_missing")
    assert [got[1][c] for c in flags] == [0, 0, 1]
    assert all(sum(r[c] for c in flags) == 1 for r in got.values())


def test_features_keep_households_without_claims(predictors, claims):
    got = by_id(hh.household_features(predictors, claims, AS_OF))
    assert set(got) == {1, 2, 3, 5}
    assert got[2]["paid_0_1y_at_fault"] == 0.0


def test_merge_keeps_unknown_credit_unless_asked(predictors, claims, outcomes):
    got = by_id(hh.merge_experience(predictors, claims, outcomes, AS_OF))
    assert set(got) == {1, 2}
    assert got[1]["credit_score"] is None and got[2]["claims_2016_at_fault"] == 0
    legacy = by_id(
        hh.merge_experience(predictors, claims, outcomes, AS_OF, legacy_zero_fill=True)
    )
    assert legacy[1]["credit_score"] == 0.0
    assert legacy[1]["prior_bi"] is None and legacy[1]["veh_lien_cnt"] is None


def test_merge_can_check_its_keys(predictors, claims, outcomes):
    with pytest.raises(ValueError):
        hh.merge_experience(
            predictors, claims, outcomes.union(outcomes), AS_OF, check_keys=True
        )


def test_modelling_table_labels(predictors, claims, outcomes):
    table = hh.modelling_table(hh.household_features(predictors, claims, AS_OF), outcomes)
    assert table.columns[:3] == ["hhld_id", "future_clm_ind", "future_clm_ind_yn"]
    labels = {r["hhld_id"]: r["future_clm_ind_yn"] for r in table.collect()}
    assert labels == {1: "No", 2: "Yes", 3: None, 5: None}
    collapsed = hh.collapse_history(table, claims, AS_OF)
    assert [c for c in collapsed.columns if c.startswith("paid_")] == [
        "paid_at_fault", "paid_not_at_fault",
    ]
    assert by_id(collapsed)[1]["paid_at_fault"] == 15.0
    swapped = hh.swap_feature(table, ["prior_insurer_bucket"], predictors, ["zipcode"])
    assert "zipcode" in swapped.columns and "prior_insurer_bucket" not in swapped.columns


def test_states_of_padded_zips(spark, predictors):
    look = spark.createDataFrame([("00123", "AA"), ("12345", "BB")], "zipcode string, state string")
    got = {r["state"]: (r["n_households"], r["share"]) for r in hh.state_distribution(predictors, look).collect()}
    assert got == {"AA": (1, 0.25), "BB": (1, 0.25), "NA": (2, 0.5)}


def test_off_list_limits_are_null(predictors):
    got = {(r["prior_limit"], r["current_limit"]): r["n_rows"] for r in hh.limit_transition(predictors).collect()}
    assert got[None, 25000.0] == 1 and got[None, 100000.0] == 1 and got[25000.0, None] == 1


def test_ratios_of_households_without_vehicles(spark):
    ddl = ", ".join(
        f"{c} int" for c in (
            "hhld_id", "veh_cnt", "drvr_cnt", "cnt_auto", "cnt_mtrcyc", "veh_own_cnt",
            "veh_lease_cnt", "veh_lien_cnt", "veh_w_coll_cnt", "veh_w_comp_cnt", "veh_w_ers_cnt",
        )
    )
    row = hh.vehicle_ratios(spark.createDataFrame([(1, 0, 2) + (0,) * 8], ddl)).first()
    assert row["veh_per_drvr"] == 0.0 and row["perc_auto"] is None
