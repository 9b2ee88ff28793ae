"""Household features, claim history and the merged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimbook.catalog import views as v
from claimbook.catalog.registry import query
from claimbook.catalog.views import with_views
from claimbook.functions import actuarial as act
from claimbook.plans import households as hh
from claimbook.sources.bucketed import write_bucketed


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(f"`{c}`", digits) for c in cols})


_BUCKETS = (("< 1 yr", "0_1y"), ("1-3 yrs", "1_3y"), ("3-5 yrs", "3_5y"), ("5+ yrs", "5y_plus"))
_FAULTS = (("_f", "at_fault"), ("_nf", "not_at_fault"))
PAID_COLUMNS = [f"paid_{slug}_{tidy}" for _, tidy in _FAULTS for _, slug in _BUCKETS]

PAID_HISTORY = (
    "SELECT hhld_id, "
    + ", ".join(
        f"round(coalesce(sum(pd_amt) FILTER (bucket = '{b}' AND fault = '{s}'), 0), 2)"
        f" AS paid_{slug}_{tidy}"
        for s, tidy in _FAULTS
        for b, slug in _BUCKETS
    )
    + " FROM paid_bucketed GROUP BY hhld_id"
)

_COUNT_NAMES = [f"claims_{y}_{tidy}" for y in range(1996, 2001) for _, tidy in _FAULTS]
_CLAIM_COUNTS = (
    "SELECT hhld_id, "
    + ", ".join(
        f"count(*) FILTER (year(clm_dates) = {y} AND aft_ind {op} 1) AS claims_{y}_{tidy}"
        for y in range(1996, 2001)
        for op, tidy in (("=", "at_fault"), ("<>", "not_at_fault"))
    )
    + " FROM claims WHERE clm_dates >= DATE '1996-01-01' AND clm_dates < DATE '2001-01-01'"
    " GROUP BY hhld_id"
)

_PAID_TOTALS = """
    SELECT hhld_id, round(coalesce(sum(pd_amt) FILTER (fault = '_f'), 0), 2) AS paid_at_fault,
           round(coalesce(sum(pd_amt) FILTER (fault = '_nf'), 0), 2) AS paid_not_at_fault
    FROM paid_bucketed GROUP BY hhld_id"""


@query("imputed_predictors", "E1 X7", with_views("SELECT * FROM filled"))
def imputed_predictors(spark, sf_dir):
    return hh.impute_predictors(v.predictors(spark, sf_dir))


@query(
    "insurer_buckets_and_dummies",
    "E2 E3 X19",
    with_views("""
        SELECT hhld_id, prior_insurer_bucket, prior_insurer_major, prior_insurer_minor,
               prior_insurer_missing FROM clean"""),
)
def insurer_buckets_and_dummies(spark, sf_dir):
    return hh.bucket_insurer(v.predictors(spark, sf_dir)).select(
        "hhld_id",
        "prior_insurer_bucket",
        "prior_insurer_major",
        "prior_insurer_minor",
        "prior_insurer_missing",
    )


@query(
    "insurer_buckets_by_pattern",
    "E2 X11",
    with_views("""
        SELECT CASE WHEN curnt_insurer ILIKE '%missing%' THEN 'Missing'
                    WHEN curnt_insurer ILIKE '%other%' THEN 'Minor_Insurer'
                    ELSE 'Major_Insurer' END AS prior_insurer_bucket, count(*) AS n_rows
        FROM predictors GROUP BY 1"""),
)
def insurer_buckets_by_pattern(spark, sf_dir):
    bucketed = hh.bucket_insurer(v.predictors(spark, sf_dir), pattern=True)
    return bucketed.groupBy("prior_insurer_bucket").agg(F.count("*").alias("n_rows"))


@query("cleaned_predictors", "E4 E5 E1 E2 E3", with_views("SELECT * FROM clean"))
def cleaned_predictors(spark, sf_dir):
    return hh.clean_predictors(v.predictors(spark, sf_dir))


@query(
    "years_ago_buckets",
    "E6 F2",
    with_views("""
        SELECT bucket, fault, count(*) AS n_claims, round(sum(pd_amt), 2) AS total_paid
        FROM paid_bucketed GROUP BY bucket, fault"""),
)
def years_ago_buckets(spark, sf_dir):
    early = v.claims(spark, sf_dir).filter(F.col("clm_dates") < F.lit(v.AS_OF))
    return early.groupBy(
        act.years_ago_bucket("clm_dates", v.AS_OF).alias("bucket"),
        act.fault_suffix("aft_ind").alias("fault"),
    ).agg(F.count("*").alias("n_claims"), F.round(F.sum("pd_amt"), 2).alias("total_paid"))


@query("paid_history_wide", "E7 R1", with_views(PAID_HISTORY))
def paid_history_wide(spark, sf_dir):
    return _rounded(hh.paid_history(v.claims(spark, sf_dir), v.AS_OF), 2, *PAID_COLUMNS)


@query(
    "paid_history_original_names",
    "R1 E7",
    with_views(
        "SELECT hhld_id, "
        + ", ".join(
            f"round(coalesce(sum(pd_amt) FILTER (bucket = '{b}' AND fault = '{s}'), 0), 2)"
            f' AS "{b}_{s}"'
            for s, _ in _FAULTS
            for b, _ in _BUCKETS
        )
        + " FROM paid_bucketed GROUP BY hhld_id"
    ),
)
def paid_history_original_names(spark, sf_dir):
    table = hh.paid_history(v.claims(spark, sf_dir), v.AS_OF, clean_names=False)
    return _rounded(table, 2, *table.columns[1:])


@query("claim_counts_wide", "E8 R2 F2", with_views(_CLAIM_COUNTS))
def claim_counts_wide(spark, sf_dir):
    return hh.claim_counts(v.claims(spark, sf_dir), v.AS_OF)


@query(
    "paid_totals_by_fault",
    "E9 R3",
    with_views(
        _PAID_TOTALS.replace("paid_at_fault", '"Paid_Amt_f"').replace(
            "paid_not_at_fault", '"Paid_Amt_nf"'
        )
    ),
)
def paid_totals_by_fault(spark, sf_dir):
    table = hh.paid_totals(v.claims(spark, sf_dir), v.AS_OF, clean_names=False)
    return _rounded(table, 2, "Paid_Amt_f", "Paid_Amt_nf")


@query(
    "features_with_history",
    "E10 J6",
    with_views(
        f"WITH h AS ({PAID_HISTORY}) SELECT c.*, "
        + ", ".join(f"coalesce(h.{n}, 0) AS {n}" for n in PAID_COLUMNS)
        + " FROM clean c LEFT JOIN h ON c.hhld_id = h.hhld_id"
    ),
)
def features_with_history(spark, sf_dir):
    table = hh.household_features(v.predictors(spark, sf_dir), v.claims(spark, sf_dir), v.AS_OF)
    return _rounded(table, 2, *PAID_COLUMNS)


_MERGED = (
    "SELECT p.*, "
    + ", ".join(f"coalesce(h.{n}, 0) AS {n}" for n in _COUNT_NAMES)
    + ", round(o.loss_amount, 4) AS loss_amount, o.premium, round(o.loss_ratio, 6) AS loss_ratio,"
    " o.future_clm_ind FROM {predictors} p LEFT JOIN h ON p.hhld_id = h.hhld_id"
    " JOIN outcomes o ON p.hhld_id = o.hhld_id"
)


@query(
    "merged_experience",
    "E11 J4 J6 J7",
    with_views(f"WITH h AS ({_CLAIM_COUNTS}) " + _MERGED.format(predictors="predictors")),
)
def merged_experience(spark, sf_dir):
    table = hh.merge_experience(
        v.predictors(spark, sf_dir),
        v.claims(spark, sf_dir),
        v.outcomes(spark, sf_dir),
        v.AS_OF,
        check_keys=True,
    )
    return _rounded(_rounded(table, 4, "loss_amount"), 6, "loss_ratio")


_BUCKETS_OF_KEYS = 16


@query(
    "merged_experience_bucketed",
    "S5 E11 J1",
    with_views(f"WITH h AS ({_CLAIM_COUNTS}) " + _MERGED.format(predictors="predictors")),
)
def merged_experience_bucketed(spark, sf_dir):
    run = uuid.uuid4().hex
    sides = [
        write_bucketed(table, f"{name}_{run}", "hhld_id", _BUCKETS_OF_KEYS)
        for name, table in (
            ("predictors", v.predictors(spark, sf_dir)),
            ("counts", hh.claim_counts(v.claims(spark, sf_dir), v.AS_OF)),
            ("outcomes", v.outcomes(spark, sf_dir)),
        )
    ]
    table = hh.merge_counted(*sides)
    return _rounded(_rounded(table, 4, "loss_amount"), 6, "loss_ratio")


@query(
    "merged_experience_zero_filled",
    "E11 J7",
    with_views(
        f"WITH h AS ({_CLAIM_COUNTS}) "
        + _MERGED.format(
            predictors="(SELECT * REPLACE (coalesce(credit_score, 0) AS credit_score) FROM predictors)"
        )
    ),
)
def merged_experience_zero_filled(spark, sf_dir):
    table = hh.merge_experience(
        v.predictors(spark, sf_dir),
        v.claims(spark, sf_dir),
        v.outcomes(spark, sf_dir),
        v.AS_OF,
        legacy_zero_fill=True,
    )
    return _rounded(_rounded(table, 4, "loss_amount"), 6, "loss_ratio")


@query(
    "model_ready_export",
    "E12 P2",
    with_views("""
        SELECT * EXCLUDE (avg_majr_viol, cnt_minr_viol, inforce_ind, prior_insurer_major,
                          prior_insurer_minor, prior_insurer_missing)
        FROM clean"""),
)
def model_ready_export(spark, sf_dir):
    return hh.export_features(hh.clean_predictors(v.predictors(spark, sf_dir)))


@query(
    "state_distribution",
    "E13 J3 A7 X7 X9",
    with_views("""
        SELECT coalesce(state, 'NA') AS state, count(*) AS n_households,
               round(count(*) / CAST((SELECT count(*) FROM predictors) AS DOUBLE), 6) AS share
        FROM predictors p LEFT JOIN zip_state z ON lpad(p.zipcode, 5, '0') = z.zipcode GROUP BY 1"""),
)
def state_distribution(spark, sf_dir):
    table = hh.state_distribution(v.predictors(spark, sf_dir), v.zip_state(spark, sf_dir))
    return _rounded(table, 6, "share")


_RATIOS = {
    "perc_auto": "cnt_auto",
    "perc_mtrcyc": "cnt_mtrcyc",
    "perc_own": "veh_own_cnt",
    "perc_lease": "veh_lease_cnt",
    "perc_lien": "veh_lien_cnt",
    "perc_coll": "veh_w_coll_cnt",
    "perc_comp": "veh_w_comp_cnt",
    "perc_ers": "veh_w_ers_cnt",
}


@query(
    "vehicle_ratios",
    "E14 X1",
    with_views(
        "SELECT hhld_id, round(CAST(veh_cnt AS DOUBLE) / drvr_cnt, 6) AS veh_per_drvr, "
        + ", ".join(f"round(CAST({c} AS DOUBLE) / veh_cnt, 6) AS {n}" for n, c in _RATIOS.items())
        + " FROM predictors"
    ),
)
def vehicle_ratios(spark, sf_dir):
    return _rounded(hh.vehicle_ratios(v.predictors(spark, sf_dir)), 6, "veh_per_drvr", *_RATIOS)


@query(
    "limit_transition",
    "E15 A8 X18 H7",
    with_views("""
        SELECT CASE WHEN prior_bi IN (0, 25000, 50000, 100000, 250000) THEN prior_bi END AS prior_limit,
               CAST(curnt_bi_low * 1000 AS DOUBLE) AS current_limit, count(*) AS n_rows,
               round(count(*) / CAST((SELECT count(*) FROM filled) AS DOUBLE), 6) AS share
        FROM filled GROUP BY 1, 2"""),
)
def limit_transition(spark, sf_dir):
    filled = hh.impute_predictors(v.predictors(spark, sf_dir))
    return _rounded(hh.limit_transition(filled), 6, "share")


@query(
    "frequency_and_severity_by_fault",
    "E16 A4 A7",
    with_views("""
        SELECT aft_ind, count(*) AS n_rows, round(avg(pd_amt), 4) AS avg_paid,
               round(stddev_samp(pd_amt), 4) AS sd_paid,
               round(count(*) / CAST((SELECT count(*) FROM claims) AS DOUBLE), 6) AS share
        FROM claims GROUP BY aft_ind"""),
)
def frequency_and_severity_by_fault(spark, sf_dir):
    table = hh.experience_summary(v.claims(spark, sf_dir), "aft_ind", {"paid": "pd_amt"})
    return _rounded(_rounded(table, 4, "avg_paid", "sd_paid"), 6, "share")


@query(
    "experience_by_future_claim",
    "E16 A4 A7",
    with_views("""
        SELECT future_clm_ind, count(*) AS n_rows, round(avg(premium), 4) AS avg_premium,
               round(stddev_samp(premium), 4) AS sd_premium, round(avg(loss_amount), 4) AS avg_loss,
               round(stddev_samp(loss_amount), 4) AS sd_loss,
               round(count(*) / CAST((SELECT count(*) FROM outcomes) AS DOUBLE), 6) AS share
        FROM outcomes GROUP BY future_clm_ind"""),
)
def experience_by_future_claim(spark, sf_dir):
    table = hh.experience_summary(
        v.outcomes(spark, sf_dir), "future_clm_ind", {"premium": "premium", "loss": "loss_amount"}
    )
    return _rounded(
        _rounded(table, 4, "avg_premium", "sd_premium", "avg_loss", "sd_loss"), 6, "share"
    )


@query(
    "portfolio_loss_ratio",
    "E16 A9",
    with_views("""
        SELECT round(sum(loss_amount), 2) AS total_loss_amount, sum(premium) AS total_premium,
               round(sum(loss_amount) / sum(premium), 6) AS total_ratio
        FROM outcomes"""),
)
def portfolio_loss_ratio(spark, sf_dir):
    table = hh.portfolio_ratio(v.outcomes(spark, sf_dir))
    return _rounded(_rounded(table, 2, "total_loss_amount"), 6, "total_ratio")


@query(
    "modelling_table",
    "G1 J1 X5 P7",
    with_views(
        f"WITH h AS ({PAID_HISTORY}) SELECT c.hhld_id, o.future_clm_ind,"
        " CASE WHEN o.future_clm_ind = 1 THEN 'Yes' ELSE 'No' END AS future_clm_ind_yn,"
        " c.* EXCLUDE (hhld_id), "
        + ", ".join(f"coalesce(h.{n}, 0) AS {n}" for n in PAID_COLUMNS)
        + " FROM clean c LEFT JOIN h ON c.hhld_id = h.hhld_id"
        " LEFT JOIN outcomes o ON c.hhld_id = o.hhld_id"
    ),
)
def modelling_table(spark, sf_dir):
    features = hh.household_features(v.predictors(spark, sf_dir), v.claims(spark, sf_dir), v.AS_OF)
    return _rounded(hh.modelling_table(features, v.outcomes(spark, sf_dir)), 2, *PAID_COLUMNS)


@query(
    "collapsed_history",
    "G15 R3 J6",
    with_views(
        f"WITH t AS ({_PAID_TOTALS}) SELECT c.hhld_id, o.future_clm_ind, c.credit_score,"
        " coalesce(t.paid_at_fault, 0) AS paid_at_fault,"
        " coalesce(t.paid_not_at_fault, 0) AS paid_not_at_fault"
        " FROM clean c LEFT JOIN t ON c.hhld_id = t.hhld_id"
        " LEFT JOIN outcomes o ON c.hhld_id = o.hhld_id"
    ),
)
def collapsed_history(spark, sf_dir):
    claims = v.claims(spark, sf_dir)
    features = hh.household_features(v.predictors(spark, sf_dir), claims, v.AS_OF)
    table = hh.modelling_table(features, v.outcomes(spark, sf_dir))
    totals = hh.collapse_history(table, claims, v.AS_OF).select(
        "hhld_id", "future_clm_ind", "credit_score", "paid_at_fault", "paid_not_at_fault"
    )
    return _rounded(totals, 2, "paid_at_fault", "paid_not_at_fault")


@query(
    "swapped_feature",
    "G16 J4 J5 P2",
    with_views("""
        SELECT c.* EXCLUDE (prior_insurer_bucket, inforce_ind), p.inforce_ind
        FROM clean c JOIN predictors p ON c.hhld_id = p.hhld_id"""),
)
def swapped_feature(spark, sf_dir):
    raw = v.predictors(spark, sf_dir)
    features = hh.clean_predictors(raw)
    return hh.swap_feature(features, ["prior_insurer_bucket", "inforce_ind"], raw, ["inforce_ind"])
