"""Sources, projections, filters, joins, aggregates, windows, reshapes, scalars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from claimbook.catalog import views as v
from claimbook.catalog.registry import query
from claimbook.catalog.views import with_views
from claimbook.functions import actuarial as act
from claimbook.functions import semantics as sem
from claimbook.operators import joins, quality, reshape, snapshots, timeseries
from claimbook.plans import households, reinsurance
from claimbook.sources import rejects, schemas, tables
from claimbook.sources.scratch import shared_folder

# ---------------------------------------------------------------- sources


@query(
    "delimited_scan_typed",
    "S1 S2 S5",
    with_views("""
        SELECT hhld_id, CAST(clm_dates AS VARCHAR) AS clm_dates, pd_amt, aft_ind FROM claims"""),
)
def delimited_scan_typed(spark, sf_dir):
    path = shared_folder(spark)
    tables.write_table(v.claims(spark, sf_dir), path, fmt="csv")
    back = tables.read_table(spark, path, schemas.CLAIMS, fmt="csv")
    return back.withColumn("clm_dates", F.col("clm_dates").cast("string"))


@query(
    "delimited_scan_named_columns",
    "S1 S2",
    with_views("""
        SELECT claim_number, CAST(loss_date AS VARCHAR) AS loss_date,
               CAST(evaluation_date AS VARCHAR) AS evaluation_date, paid_loss, reserve_loss, period
        FROM excess_named"""),
)
def delimited_scan_named_columns(spark, sf_dir):
    path = shared_folder(spark)
    order = [f.name for f in schemas.LOSS_RUN_EXCESS.fields]
    run = v.loss_run_excess(spark, sf_dir).select(*[f"`{c}`" for c in order])
    tables.write_table(run, path, fmt="csv")
    back = tables.read_table(spark, path, schemas.LOSS_RUN_EXCESS, fmt="csv")
    named = reinsurance.clean_excess_names(back)
    return named.withColumns(
        {c: F.col(c).cast("string") for c in ("loss_date", "evaluation_date")}
    )


# Claims as text with planted faults: missing keys, and dates, amounts and flags that do not parse.
_FAULTY_SQL = """
    keyed AS (SELECT *, hhld_id * 7 + CAST(floor(pd_amt) AS BIGINT) AS k FROM claims),
    faults AS (SELECT *, concat_ws('; ', CASE WHEN k % 17 = 0 THEN 'clm_dates: not DATE' END,
                 CASE WHEN k % 13 = 0 THEN 'pd_amt: not DOUBLE' END, CASE WHEN k % 11 = 0 THEN 'aft_ind: not INT' END,
                 CASE WHEN k % 31 = 0 THEN 'hhld_id: missing' END) AS reason FROM keyed)"""


def _faulty(spark, sf_dir):
    """The faulty text, read with its faults kept apart."""
    k = F.col("hhld_id") * 7 + F.floor("pd_amt")
    text = v.claims(spark, sf_dir).select(
        F.when(k % 31 == 0, F.lit(None)).otherwise(F.col("hhld_id").cast("string")).alias("hhld_id"),
        F.when(k % 17 == 0, "31/31/2015").otherwise(F.date_format("clm_dates", schemas.DATE_PATTERN)).alias("clm_dates"),
        F.when(k % 13 == 0, "n/a").otherwise(F.col("pd_amt").cast("string")).alias("pd_amt"),
        F.when(k % 11 == 0, "yes").otherwise(F.col("aft_ind").cast("string")).alias("aft_ind"),
    )
    path = shared_folder(spark)
    tables.write_table(text, path, fmt="csv")
    return rejects.read_checked(spark, path, schemas.CLAIMS, required=["hhld_id"])


@query(
    "checked_scan_kept",
    "S1 S2 S3",
    with_views(f"""WITH {_FAULTY_SQL.strip()}
        SELECT hhld_id, CAST(clm_dates AS VARCHAR) AS clm_dates, pd_amt, aft_ind FROM faults WHERE reason = ''"""),
)
def checked_scan_kept(spark, sf_dir):
    return _faulty(spark, sf_dir).kept.withColumn("clm_dates", F.col("clm_dates").cast("string"))


@query(
    "checked_scan_rejected",
    "S1 S2 S3",
    with_views(f"""WITH {_FAULTY_SQL.strip()}
        SELECT reason, CAST(length(reason) - length(replace(reason, ';', '')) + 1 AS INTEGER) AS n_problems,
               count(*) AS n_rows FROM faults WHERE reason <> '' GROUP BY 1, 2"""),
)
def checked_scan_rejected(spark, sf_dir):
    """Rejected rows by their reasons."""
    rejected = _faulty(spark, sf_dir).rejected
    return rejected.groupBy("reason", "n_problems").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "parse_text_dates",
    "S3",
    """
    WITH texts AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'not a date'
               ELSE strftime(o_orderdate, '%-m/%-d/%Y %-H:%M') END AS stamp FROM orders)
    SELECT o_orderkey,
           CAST(CAST(try_strptime(stamp, '%-m/%-d/%Y %-H:%M') AS DATE) AS VARCHAR) AS parsed_date,
           strftime(try_strptime(stamp, '%-m/%-d/%Y %-H:%M'), '%Y-%m-%d %H:%M') AS parsed_minute
    FROM texts""",
)
def parse_text_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 10 == 0, "not a date").otherwise(
        F.date_format("o_orderdate", "M/d/yyyy H:mm")
    )
    orders = v.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.alias("parsed_date"), text.alias("parsed_minute")
    )
    patterns = dict.fromkeys(["parsed_date", "parsed_minute"], schemas.DATE_TIME_PATTERN)
    parsed = tables.parse_dates(orders, patterns, keep_time=["parsed_minute"])
    return parsed.select(
        "o_orderkey",
        F.col("parsed_date").cast("string").alias("parsed_date"),
        F.date_format("parsed_minute", "yyyy-MM-dd HH:mm").alias("parsed_minute"),
    )


@query(
    "reference_lookup",
    "S4 J3 X9 X7",
    with_views("""
        SELECT p.hhld_id, lpad(p.zipcode, 5, '0') AS zipcode, coalesce(z.state, 'NA') AS state
        FROM predictors p LEFT JOIN zip_state z ON lpad(p.zipcode, 5, '0') = z.zipcode"""),
)
def reference_lookup(spark, sf_dir):
    zips = v.predictors(spark, sf_dir).select(
        "hhld_id", sem.pad_zero("zipcode", 5).alias("zipcode")
    )
    named = joins.join_lookup(zips, v.zip_state(spark, sf_dir), "zipcode")
    return named.withColumn("state", F.coalesce("state", F.lit("NA")))


@query(
    "write_and_reread_features",
    "S5",
    with_views("""
        SELECT * EXCLUDE (avg_majr_viol, cnt_minr_viol, inforce_ind, prior_insurer_major,
                          prior_insurer_minor, prior_insurer_missing)
        FROM clean"""),
)
def write_and_reread_features(spark, sf_dir):
    path = shared_folder(spark)
    features = households.export_features(
        households.clean_predictors(v.predictors(spark, sf_dir))
    )
    tables.write_table(features, path)
    return tables.read_table(spark, path, features.schema)


# ------------------------------------------------- projection and renaming


@query(
    "select_columns",
    "P1 P7",
    with_views("SELECT veh_cnt, hhld_id, veh_own_cnt, veh_lease_cnt FROM predictors"),
)
def select_columns(spark, sf_dir):
    return v.predictors(spark, sf_dir).select("veh_cnt", "hhld_id", "veh_own_cnt", "veh_lease_cnt")


@query(
    "drop_columns",
    "P2",
    with_views("SELECT * EXCLUDE (zipcode, curnt_insurer, curnt_bi_upp) FROM predictors"),
)
def drop_columns(spark, sf_dir):
    return v.predictors(spark, sf_dir).drop("zipcode", "curnt_insurer", "curnt_bi_upp")


@query(
    "select_by_name_pattern",
    "P3",
    with_views("""
        SELECT hhld_id, min_age, avg_age, max_age, hoh_age, min_mon_lic, avg_mon_lic, max_mon_lic,
               hoh_mon_lic, veh_w_coll_cnt, veh_w_comp_cnt, veh_w_ers_cnt
        FROM predictors"""),
)
def select_by_name_pattern(spark, sf_dir):
    df = v.predictors(spark, sf_dir)
    return df.select(
        "hhld_id", *reshape.columns_matching(df, contains=["AGE", "mon_lic"], starts_with="veh_w")
    )


@query(
    "select_columns_with_nulls",
    "P4",
    with_views(
        "SELECT hhld_id, prior_bi, time_w_carr, credit_score, veh_lien_cnt FROM predictors"
    ),
)
def select_columns_with_nulls(spark, sf_dir):
    df = v.predictors(spark, sf_dir)
    return df.select("hhld_id", *quality.columns_with_nulls(df))


@query(
    "rename_columns",
    "P5 P6",
    with_views("""
        SELECT hhld_id, curnt_bi_low AS current_limit, drvr_cnt AS drivers, veh_cnt AS vehicles
        FROM predictors"""),
)
def rename_columns(spark, sf_dir):
    return (
        v.predictors(spark, sf_dir)
        .select("hhld_id", F.col("curnt_bi_low").alias("current_limit"), "drvr_cnt", "veh_cnt")
        .withColumnsRenamed({"drvr_cnt": "drivers", "veh_cnt": "vehicles"})
    )


@query(
    "computed_columns",
    "P8 P9 P10 X1 X16",
    with_views("""
        SELECT hhld_id, round(CAST(veh_own_cnt AS DOUBLE) / veh_cnt, 6) AS perc_own,
               round(CAST(veh_lease_cnt AS DOUBLE) / veh_cnt, 6) AS perc_lease,
               curnt_bi_low * 1000 AS limit_dollars,
               round(avg_mon_lic / 12, 6) AS avg_years_lic, 'predictors' AS data_source
        FROM predictors"""),
)
def computed_columns(spark, sf_dir):
    return (
        v.predictors(spark, sf_dir)
        .select("hhld_id", "veh_cnt", "veh_own_cnt", "veh_lease_cnt", "curnt_bi_low", "avg_mon_lic")
        .withColumns(
            {
                "perc_own": F.round(sem.safe_div("veh_own_cnt", "veh_cnt"), 6),
                "perc_lease": F.round(sem.safe_div("veh_lease_cnt", "veh_cnt"), 6),
                "limit_dollars": F.col("curnt_bi_low") * 1000,
                "avg_years_lic": F.round(F.col("avg_mon_lic") / 12, 6),
                "data_source": F.lit("predictors"),
            }
        )
        .drop("veh_cnt", "veh_own_cnt", "veh_lease_cnt", "curnt_bi_low", "avg_mon_lic")
    )


# --------------------------------------------------------- filters and sorts


@query(
    "comparison_filters",
    "F1 F3 F4 F5",
    with_views("""
        SELECT hhld_id, drvr_cnt, veh_cnt, credit_score FROM predictors
        WHERE credit_score IS NOT NULL AND veh_lien_cnt IS NULL AND drvr_cnt IN (1, 2, 3)
          AND (veh_cnt > 2 OR curnt_insurer <> 'MISSING') AND credit_score >= 400"""),
)
def comparison_filters(spark, sf_dir):
    return (
        v.predictors(spark, sf_dir)
        .filter(F.col("credit_score").isNotNull() & F.col("veh_lien_cnt").isNull())
        .filter(F.col("drvr_cnt").isin(1, 2, 3))
        .filter((F.col("veh_cnt") > 2) | (F.col("curnt_insurer") != "MISSING"))
        .filter(F.col("credit_score") >= 400)
        .select("hhld_id", "drvr_cnt", "veh_cnt", "credit_score")
    )


@query(
    "date_range_filter",
    "F2",
    with_views("""
        SELECT hhld_id, CAST(clm_dates AS VARCHAR) AS clm_dates, pd_amt FROM claims
        WHERE clm_dates >= DATE '1996-01-01' AND clm_dates < DATE '2001-01-01'"""),
)
def date_range_filter(spark, sf_dir):
    low, high = F.lit(dt.date(1996, 1, 1)), F.lit(v.AS_OF)
    return (
        v.claims(spark, sf_dir)
        .filter((F.col("clm_dates") >= low) & (F.col("clm_dates") < high))
        .select("hhld_id", F.col("clm_dates").cast("string").alias("clm_dates"), "pd_amt")
    )


@query(
    "sentinel_exclusion",
    "F6",
    with_views("""
        SELECT "a.trip_identifier" AS trip_identifier, "b.risk_segment" AS risk_segment FROM trips
        WHERE "a.trip_status" <> 'canceled' AND "b.risk_segment" <> '\\N'"""),
)
def sentinel_exclusion(spark, sf_dir):
    return (
        v.trips(spark, sf_dir)
        .filter(
            (F.col("`a.trip_status`") != reinsurance.CANCELED)
            & (F.col("`b.risk_segment`") != F.lit(reinsurance.UNKNOWN_SEGMENT))
        )
        .select(
            F.col("`a.trip_identifier`").alias("trip_identifier"),
            F.col("`b.risk_segment`").alias("risk_segment"),
        )
    )


@query(
    "post_aggregate_filter",
    "F7 A3",
    with_views("""
        SELECT hhld_id, round(sum(pd_amt), 2) AS total_paid, count(*) AS n_claims FROM claims
        GROUP BY hhld_id HAVING count(*) > 12"""),
)
def post_aggregate_filter(spark, sf_dir):
    return (
        v.claims(spark, sf_dir)
        .groupBy("hhld_id")
        .agg(F.round(F.sum("pd_amt"), 2).alias("total_paid"), F.count("*").alias("n_claims"))
        .filter("n_claims > 12")
    )


@query(
    "tolerance_and_threshold_filters",
    "F8 F9 X2 X4",
    with_views("""
        SELECT hhld_id, round_even(loss_ratio, 3) AS ratio_3 FROM outcomes
        WHERE round_even(loss_ratio, 3) <> 0 AND abs(loss_ratio - 10) > 2.5"""),
)
def tolerance_and_threshold_filters(spark, sf_dir):
    return (
        v.outcomes(spark, sf_dir)
        .withColumn("ratio_3", sem.round_even("loss_ratio", 3))
        .filter((F.col("ratio_3") != 0) & (F.abs(F.col("loss_ratio") - 10) > 2.5))
        .select("hhld_id", "ratio_3")
    )


@query(
    "sort_by_level_order",
    "L1 X17",
    with_views("""
        SELECT bucket, CAST(CASE bucket WHEN '< 1 yr' THEN 1 WHEN '1-3 yrs' THEN 2
                 WHEN '3-5 yrs' THEN 3 ELSE 4 END AS INTEGER) AS bucket_rank, fault,
               count(*) AS n_claims
        FROM paid_bucketed GROUP BY bucket, fault ORDER BY 2, 3"""),
)
def sort_by_level_order(spark, sf_dir):
    bucketed = v.claims(spark, sf_dir).filter(F.col("clm_dates") < F.lit(v.AS_OF)).select(
        act.years_ago_bucket("clm_dates", v.AS_OF).alias("bucket"),
        act.fault_suffix("aft_ind").alias("fault"),
    )
    return (
        bucketed.groupBy("bucket", "fault")
        .agg(F.count("*").alias("n_claims"))
        .withColumn("bucket_rank", sem.level_rank("bucket", act.YEARS_AGO_LEVELS))
        .orderBy(*sem.ascending("bucket_rank", "fault"))
    )


@query(
    "top_households_by_age",
    "L2 L3",
    with_views("""
        SELECT hhld_id, avg_age FROM predictors ORDER BY avg_age DESC, hhld_id LIMIT 500"""),
)
def top_households_by_age(spark, sf_dir):
    return (
        v.predictors(spark, sf_dir)
        .select("hhld_id", "avg_age")
        .orderBy(*sem.descending("avg_age"), *sem.ascending("hhld_id"))
        .limit(500)
    )


# ------------------------------------------------------------- joins and sets


@query(
    "left_join_one_key",
    "J1 J5",
    with_views("""
        SELECT c.hhld_id, CAST(c.clm_dates AS VARCHAR) AS clm_dates, c.pd_amt, p.curnt_insurer,
               p.credit_score
        FROM claims c LEFT JOIN predictors p ON c.hhld_id = p.hhld_id"""),
)
def left_join_one_key(spark, sf_dir):
    side = v.predictors(spark, sf_dir).select("hhld_id", "curnt_insurer", "credit_score")
    joined = v.claims(spark, sf_dir).drop("aft_ind").join(side, "hhld_id", "left")
    return joined.withColumn("clm_dates", F.col("clm_dates").cast("string"))


@query(
    "left_join_renamed_keys",
    "J2",
    with_views("""
        SELECT y.accident_year, y.n_claims, t.n_trips
        FROM (SELECT CAST(year(clm_dates) AS INTEGER) AS accident_year, count(*) AS n_claims
              FROM claims GROUP BY 1) y
        LEFT JOIN (SELECT CAST(year(start_time) AS INTEGER) AS trip_year, count(*) AS n_trips
                   FROM trips_clean GROUP BY 1) t ON y.accident_year = t.trip_year"""),
)
def left_join_renamed_keys(spark, sf_dir):
    yearly = v.claims(spark, sf_dir).groupBy(F.year("clm_dates").alias("accident_year")).agg(
        F.count("*").alias("n_claims")
    )
    miles = reinsurance.exposure(reinsurance.clean_trips(v.trips(spark, sf_dir)))
    return joins.join_keyed(
        yearly, miles.select("trip_year", "n_trips"), {"accident_year": "trip_year"}
    )


@query(
    "inner_join_one_key",
    "J4",
    with_views("""
        SELECT c.hhld_id, c.pd_amt, o.premium, o.future_clm_ind
        FROM claims c JOIN outcomes o ON c.hhld_id = o.hhld_id"""),
)
def inner_join_one_key(spark, sf_dir):
    response = v.outcomes(spark, sf_dir).select("hhld_id", "premium", "future_clm_ind")
    return v.claims(spark, sf_dir).select("hhld_id", "pd_amt").join(response, "hhld_id", "inner")


@query(
    "left_join_zero_fill",
    "J6 J7",
    with_views("""
        SELECT p.hhld_id, p.credit_score, p.prior_bi,
               coalesce(c.paid_at_fault, 0) AS paid_at_fault,
               coalesce(c.paid_not_at_fault, 0) AS paid_not_at_fault
        FROM predictors p LEFT JOIN (
          SELECT hhld_id,
                 round(coalesce(sum(pd_amt) FILTER (aft_ind = 1), 0), 2) AS paid_at_fault,
                 round(coalesce(sum(pd_amt) FILTER (aft_ind <> 1), 0), 2) AS paid_not_at_fault
          FROM claims WHERE clm_dates < DATE '2001-01-01' GROUP BY hhld_id) c
          ON p.hhld_id = c.hhld_id"""),
)
def left_join_zero_fill(spark, sf_dir):
    totals = households.paid_totals(v.claims(spark, sf_dir), v.AS_OF)
    rounded = totals.withColumns(
        {c: F.round(c, 2) for c in ("paid_at_fault", "paid_not_at_fault")}
    )
    left = v.predictors(spark, sf_dir).select("hhld_id", "credit_score", "prior_bi")
    return joins.join_fill(left, rounded, "hhld_id")


@query(
    "scores_stay_with_their_key",
    "J8",
    with_views("""
        WITH s AS (SELECT avg(min_age) AS m1, stddev_samp(min_age) AS s1,
                          avg(max_age) AS m2, stddev_samp(max_age) AS s2 FROM predictors)
        SELECT hhld_id, drvr_cnt,
               round((min_age - m1) / s1 * sqrt(0.5) + (max_age - m2) / s2 * sqrt(0.5), 6) AS age_pc1
        FROM predictors, s"""),
)
def scores_stay_with_their_key(spark, sf_dir):
    from claimbook.operators import pca

    df = v.predictors(spark, sf_dir).select("hhld_id", "drvr_cnt", "min_age", "max_age")
    model = pca.fit_pca(df, ["min_age", "max_age"], 1, "age_pc")
    scored = pca.pca_scores(model, df)
    return scored.select("hhld_id", "drvr_cnt", F.round("age_pc1", 6).alias("age_pc1"))


@query(
    "many_to_one_guard",
    "J9",
    with_views("""
        SELECT hhld_id, count(*) AS n_rows FROM claims GROUP BY hhld_id HAVING count(*) > 1"""),
)
def many_to_one_guard(spark, sf_dir):
    joins.require_unique(v.outcomes(spark, sf_dir), "hhld_id")
    return joins.duplicate_keys(v.claims(spark, sf_dir), "hhld_id")


@query(
    "union_by_name",
    "U1",
    with_views("""
        SELECT 'claims' AS data_source, hhld_id, pd_amt, CAST(NULL AS DOUBLE) AS premium FROM claims
        UNION ALL
        SELECT 'outcomes', hhld_id, NULL, premium FROM outcomes"""),
)
def union_by_name(spark, sf_dir):
    first = v.claims(spark, sf_dir).select(F.lit("claims").alias("data_source"), "hhld_id", "pd_amt")
    second = v.outcomes(spark, sf_dir).select(
        F.lit("outcomes").alias("data_source"), "premium", "hhld_id"
    )
    return first.unionByName(second, allowMissingColumns=True)


@query(
    "distinct_rows",
    "U2 D14",
    with_views("SELECT DISTINCT coverage, period FROM loss_run_primary"),
)
def distinct_rows(spark, sf_dir):
    return v.loss_run_primary(spark, sf_dir).select("coverage", "period").distinct()


# ---------------------------------------------------------------- aggregation


@query(
    "row_counts_with_null_group",
    "A1 A2",
    with_views("""
        SELECT prior_bi, time_w_carr, curnt_insurer, count(*) AS n_rows
        FROM predictors GROUP BY ALL"""),
)
def row_counts_with_null_group(spark, sf_dir):
    return (
        v.predictors(spark, sf_dir)
        .groupBy("prior_bi", "time_w_carr", "curnt_insurer")
        .agg(F.count("*").alias("n_rows"))
    )


@query(
    "mean_and_deviation",
    "A4",
    with_views("""
        SELECT aft_ind, round(avg(pd_amt), 4) AS avg_paid, round(stddev_samp(pd_amt), 4) AS sd_paid
        FROM claims GROUP BY aft_ind"""),
)
def mean_and_deviation(spark, sf_dir):
    return v.claims(spark, sf_dir).groupBy("aft_ind").agg(
        F.round(F.avg("pd_amt"), 4).alias("avg_paid"),
        F.round(F.stddev_samp("pd_amt"), 4).alias("sd_paid"),
    )


@query(
    "distinct_counts",
    "A5 A6",
    with_views("""
        SELECT period, count(DISTINCT claim_number) AS n_claims,
               (SELECT count(DISTINCT claim_number) FROM loss_run_primary) AS n_claims_all
        FROM loss_run_primary GROUP BY period"""),
)
def distinct_counts(spark, sf_dir):
    run = v.loss_run_primary(spark, sf_dir).select("period", "claim_number")
    overall = run.agg(F.count_distinct("claim_number")).scalar()
    counted = run.groupBy("period").agg(sem.distinct_count("claim_number").alias("n_claims"))
    return counted.withColumn("n_claims_all", overall)


@query(
    "ratio_of_totals",
    "A9 A15",
    with_views("""
        SELECT round(sum(loss_amount), 2) AS total_loss_amount, sum(premium) AS total_premium,
               round(sum(loss_amount) / sum(premium), 6) AS total_ratio FROM outcomes"""),
)
def ratio_of_totals(spark, sf_dir):
    return households.portfolio_ratio(v.outcomes(spark, sf_dir)).select(
        F.round("total_loss_amount", 2).alias("total_loss_amount"),
        "total_premium",
        F.round("total_ratio", 6).alias("total_ratio"),
    )


@query(
    "scalar_statistic_as_literal",
    "A10",
    with_views("""
        SELECT hhld_id, round(coalesce(credit_score, (SELECT avg(credit_score) FROM predictors)), 6)
                 AS credit_score,
               round(avg_age - (SELECT min(avg_age) FROM predictors), 6) AS age_above_min
        FROM predictors"""),
)
def scalar_statistic_as_literal(spark, sf_dir):
    df = v.predictors(spark, sf_dir).select("hhld_id", "credit_score", "avg_age")
    mean_credit = df.agg(F.avg("credit_score")).scalar()
    youngest = df.agg(F.min("avg_age")).scalar()
    return df.select(
        "hhld_id",
        F.round(F.coalesce(F.col("credit_score"), mean_credit), 6).alias("credit_score"),
        F.round(F.col("avg_age") - youngest, 6).alias("age_above_min"),
    )


@query(
    "multi_measure_aggregate",
    "A12 A13",
    with_views("""
        SELECT coverage, round(sum(incurred_loss), 3) AS total_incurred,
               round(sum(ceded_loss), 3) AS total_ceded,
               CAST(sum(is_ceded) AS BIGINT) AS n_ceded,
               count(*) FILTER (paid_loss >= 1000000) AS n_capped, count(*) AS n_rows
        FROM valued_primary GROUP BY coverage"""),
)
def multi_measure_aggregate(spark, sf_dir):
    valued = reinsurance.value_losses(
        v.loss_run_primary(spark, sf_dir), *reinsurance.PRIMARY_LAYER
    )
    return valued.groupBy("coverage").agg(
        F.round(F.sum("incurred_loss"), 3).alias("total_incurred"),
        F.round(F.sum("ceded_loss"), 3).alias("total_ceded"),
        F.sum("is_ceded").alias("n_ceded"),
        F.count_if(F.col("paid_loss") >= 1000000).alias("n_capped"),
        F.count("*").alias("n_rows"),
    )


@query(
    "reaggregate_unioned_aggregates",
    "A14",
    with_views("""
        SELECT year, CAST(sum(n) AS BIGINT) AS n_rows FROM (
          SELECT CAST(year(clm_dates) AS INTEGER) AS year, count(*) AS n FROM claims GROUP BY 1
          UNION ALL
          SELECT CAST(year(loss_date) AS INTEGER), count(*) FROM loss_run_primary GROUP BY 1)
        GROUP BY year"""),
)
def reaggregate_unioned_aggregates(spark, sf_dir):
    first = v.claims(spark, sf_dir).groupBy(F.year("clm_dates").alias("year")).count()
    second = v.loss_run_primary(spark, sf_dir).groupBy(F.year("loss_date").alias("year")).count()
    return first.unionByName(second).groupBy("year").agg(F.sum("count").alias("n_rows"))


# -------------------------------------------------------------------- windows


@query(
    "snapshot_flags",
    "W1 W2",
    with_views("""
        SELECT claim_number, claimant_name, feature_identifier,
               CAST(evaluation_date AS VARCHAR) AS evaluation_date, is_latest, is_first
        FROM flagged_primary"""),
)
def snapshot_flags(spark, sf_dir):
    flagged = snapshots.flag_snapshots(
        v.loss_run_primary(spark, sf_dir), reinsurance.PRIMARY_KEYS, "evaluation_date"
    )
    return flagged.select(
        "claim_number",
        "claimant_name",
        "feature_identifier",
        F.col("evaluation_date").cast("string").alias("evaluation_date"),
        "is_latest",
        "is_first",
    )


@query(
    "latest_snapshots",
    "W3",
    with_views("""
        SELECT claim_number, claimant_name, feature_identifier,
               CAST(evaluation_date AS VARCHAR) AS evaluation_date, paid_loss
        FROM flagged_primary WHERE is_latest = 1"""),
)
def latest_snapshots(spark, sf_dir):
    kept = snapshots.keep_latest(
        v.loss_run_primary(spark, sf_dir), reinsurance.PRIMARY_KEYS, "evaluation_date"
    )
    return kept.select(
        "claim_number",
        "claimant_name",
        "feature_identifier",
        F.col("evaluation_date").cast("string").alias("evaluation_date"),
        "paid_loss",
    )


@query(
    "first_snapshots",
    "W4",
    with_views("""
        SELECT claim_number, period, CAST(evaluation_date AS VARCHAR) AS evaluation_date, paid_loss
        FROM flagged_excess WHERE is_first = 1"""),
)
def first_snapshots(spark, sf_dir):
    run = reinsurance.clean_excess_names(v.loss_run_excess(spark, sf_dir))
    kept = snapshots.keep_first(run, reinsurance.EXCESS_KEYS, "evaluation_date")
    return kept.select(
        "claim_number",
        "period",
        F.col("evaluation_date").cast("string").alias("evaluation_date"),
        "paid_loss",
    )


@query(
    "centred_moving_average",
    "W5",
    with_views("""
        WITH m AS (SELECT aft_ind, date_trunc('month', clm_dates) AS month, count(*) AS n
                   FROM claims WHERE clm_dates < DATE '2001-01-01' GROUP BY 1, 2)
        SELECT aft_ind, CAST(CAST(month AS DATE) AS VARCHAR) AS month, n AS n_claims,
               round(CASE WHEN count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
                 THEN (sum(n) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                       + 0.5 * lag(n, 6) OVER w + 0.5 * lead(n, 6) OVER w) / 12 END, 6) AS trend
        FROM m WINDOW w AS (PARTITION BY aft_ind ORDER BY month)"""),
)
def centred_moving_average(spark, sf_dir):
    early = v.claims(spark, sf_dir).filter(F.col("clm_dates") < F.lit(v.AS_OF))
    series = timeseries.monthly(early, "clm_dates", {"n_claims": F.count("*")}, ["aft_ind"])
    parts = timeseries.decompose(series, "month", "n_claims", ["aft_ind"])
    return parts.select(
        "aft_ind",
        F.col("month").cast("string").alias("month"),
        "n_claims",
        F.round("trend", 6).alias("trend"),
    )


# -------------------------------------------------------------------- reshape


@query(
    "unpivot_all_columns",
    "R4",
    with_views("""
        SELECT hhld_id, name, value FROM (
          SELECT hhld_id, CAST(cnt_auto AS DOUBLE) AS cnt_auto, CAST(cnt_mtrcyc AS DOUBLE) AS cnt_mtrcyc,
                 CAST(veh_cnt AS DOUBLE) AS veh_cnt, credit_score FROM predictors)
        UNPIVOT INCLUDE NULLS (value FOR name IN (cnt_auto, cnt_mtrcyc, veh_cnt, credit_score))"""),
)
def unpivot_all_columns(spark, sf_dir):
    df = v.predictors(spark, sf_dir).select(
        "hhld_id", "cnt_auto", "cnt_mtrcyc", "veh_cnt", "credit_score"
    )
    return reshape.unpivot_columns(df, ["hhld_id"])


@query(
    "unpivot_name_family",
    "R5",
    with_views("""
        SELECT hhld_id, who, age FROM (
          SELECT hhld_id, min_age AS "min", avg_age AS "avg", max_age AS "max", hoh_age AS hoh
          FROM predictors) UNPIVOT (age FOR who IN ("min", "avg", "max", hoh))"""),
)
def unpivot_name_family(spark, sf_dir):
    return reshape.unpivot_family(
        v.predictors(spark, sf_dir), ["hhld_id"], r"^(.*)_age$", "who", "age"
    )


@query(
    "unpivot_two_families",
    "R6",
    with_views("""
        SELECT hhld_id, 'susp' AS violation_type, CAST(cnt_lic_susp AS DOUBLE) AS violations
        FROM predictors
        UNION ALL
        SELECT hhld_id, violation_type, violations FROM (
          SELECT hhld_id, CAST(cnt_minr_viol AS DOUBLE) AS cnt_minr, avg_minr_viol AS avg_minr,
                 CAST(cnt_majr_viol AS DOUBLE) AS cnt_majr, avg_majr_viol AS avg_majr FROM predictors)
        UNPIVOT (violations FOR violation_type IN (cnt_minr, avg_minr, cnt_majr, avg_majr))"""),
)
def unpivot_two_families(spark, sf_dir):
    df = v.predictors(spark, sf_dir)
    names = {"name": "violation_type", "value": "violations"}
    first = reshape.unpivot_family(df, ["hhld_id"], r"(susp)", **names)
    second = reshape.unpivot_family(df, ["hhld_id"], r"^(.*)_viol$", **names)
    return first.unionByName(second)


# -------------------------------------------------------------------- scalars


@query(
    "null_guarded_extremes",
    "X3",
    with_views("""
        SELECT hhld_id, CASE WHEN credit_score IS NOT NULL AND prior_bi IS NOT NULL
                 THEN least(credit_score, prior_bi / 100) END AS smaller,
               CASE WHEN credit_score IS NOT NULL AND prior_bi IS NOT NULL
                 THEN greatest(credit_score, prior_bi / 100) END AS larger,
               least(greatest(avg_age, 25), 60) AS clamped_age
        FROM predictors"""),
)
def null_guarded_extremes(spark, sf_dir):
    limit = F.col("prior_bi") / 100
    return v.predictors(spark, sf_dir).select(
        "hhld_id",
        sem.min_of("credit_score", limit).alias("smaller"),
        sem.max_of("credit_score", limit).alias("larger"),
        sem.min_of(sem.max_of("avg_age", 25.0), 60.0).alias("clamped_age"),
    )


@query(
    "conditional_labels",
    "X5 X6 X8 X11",
    with_views("""
        SELECT hhld_id, CASE WHEN inforce_ind = 1 THEN 'in force' ELSE 'lapsed' END AS policy_state,
               CASE WHEN regexp_matches(curnt_insurer, '(?i)missing') THEN 'Missing'
                    WHEN regexp_matches(curnt_insurer, '(?i)other') THEN 'Minor_Insurer'
                    ELSE 'Major_Insurer' END AS insurer_bucket,
               CASE WHEN hhld_id = 27 THEN 0 ELSE drvr_cnt END AS drvr_cnt
        FROM predictors"""),
)
def conditional_labels(spark, sf_dir):
    return v.predictors(spark, sf_dir).select(
        "hhld_id",
        F.when(F.col("inforce_ind") == 1, "in force")
        .when(F.col("inforce_ind").isNotNull(), "lapsed")
        .alias("policy_state"),
        act.insurer_bucket("curnt_insurer", pattern=True).alias("insurer_bucket"),
        F.when(F.col("hhld_id") == 27, 0).otherwise(F.col("drvr_cnt")).alias("drvr_cnt"),
    )


@query(
    "composite_text_key",
    "X10",
    with_views("""
        SELECT hhld_id, CAST(hhld_id AS VARCHAR) || '|' || coalesce(CAST(veh_lien_cnt AS VARCHAR), 'NA')
                 || '|' || curnt_insurer AS text_key
        FROM predictors"""),
)
def composite_text_key(spark, sf_dir):
    return v.predictors(spark, sf_dir).select(
        "hhld_id", sem.composite_key("hhld_id", "veh_lien_cnt", "curnt_insurer").alias("text_key")
    )


@query(
    "calendar_functions",
    "X12 X13 X14",
    with_views("""
        SELECT claim_number, feature_identifier, CAST(year(loss_date) AS INTEGER) AS accident_year,
               CAST(CAST(date_trunc('month', loss_date) AS DATE) AS VARCHAR) AS loss_month,
               CAST(date_diff('day', loss_date, evaluation_date) AS INTEGER) AS age_days,
               round_even(date_diff('day', loss_date, evaluation_date) / CAST(30 AS DOUBLE), 4)
                 AS age_months
        FROM loss_run_primary"""),
)
def calendar_functions(spark, sf_dir):
    return v.loss_run_primary(spark, sf_dir).select(
        "claim_number",
        "feature_identifier",
        F.year("loss_date").alias("accident_year"),
        F.trunc("loss_date", "month").cast("string").alias("loss_month"),
        F.datediff("evaluation_date", "loss_date").alias("age_days"),
        act.maturity("loss_date", "evaluation_date").alias("age_months"),
    )


@query(
    "elapsed_minutes",
    "X15",
    with_views("""
        SELECT "a.trip_identifier" AS trip_identifier,
               date_diff('second', "a.begintrip_timestamp_local", "a.endtrip_timestamp_local")
                 / CAST(60 AS DOUBLE) AS minutes
        FROM trips"""),
)
def elapsed_minutes(spark, sf_dir):
    return v.trips(spark, sf_dir).select(
        F.col("`a.trip_identifier`").alias("trip_identifier"),
        act.minutes_between(
            "`a.begintrip_timestamp_local`", "`a.endtrip_timestamp_local`"
        ).alias("minutes"),
    )


@query(
    "levels_and_dummies",
    "X18 X19",
    with_views("""
        SELECT hhld_id, CASE WHEN prior_bi IN (25000, 50000, 100000) THEN prior_bi END AS listed_limit,
               CASE WHEN curnt_insurer NOT IN ('MISSING', 'OTHER') THEN 1 ELSE 0 END AS is_major,
               CASE WHEN curnt_insurer = 'OTHER' THEN 1 ELSE 0 END AS is_minor
        FROM predictors"""),
)
def levels_and_dummies(spark, sf_dir):
    bucket = act.insurer_bucket("curnt_insurer")
    return v.predictors(spark, sf_dir).select(
        "hhld_id",
        sem.in_levels("prior_bi", [25000.0, 50000.0, 100000.0]).alias("listed_limit"),
        (bucket == "Major_Insurer").cast("int").alias("is_major"),
        (bucket == "Minor_Insurer").cast("int").alias("is_minor"),
    )
