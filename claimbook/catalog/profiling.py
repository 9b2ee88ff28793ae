"""Data-quality checks, distribution tables and monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimbook.catalog import views as v
from claimbook.catalog.registry import query
from claimbook.catalog.views import with_views
from claimbook.functions import actuarial as act
from claimbook.functions import semantics as sem
from claimbook.operators import distributions as dist
from claimbook.operators import quality, reshape, timeseries
from claimbook.plans import households, reinsurance
from claimbook.sources.scratch import materialize


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _primary(spark, sf_dir):
    return reinsurance.value_losses(v.loss_run_primary(spark, sf_dir), *reinsurance.PRIMARY_LAYER)


def _latest(spark, sf_dir, *cols):
    """Latest-valuation rows, written once because a histogram reads them twice."""
    developed = reinsurance.develop(v.loss_run_primary(spark, sf_dir))
    return materialize(developed.filter("is_latest = 1").select(*cols))


def _trips(spark, sf_dir):
    return reinsurance.clean_trips(v.trips(spark, sf_dir))


# ------------------------------------------------------------- profiling

# Every numeric column of the predictor table.
_SUMMARY_COLS = (
    "inforce_ind", "prior_bi", "time_w_carr", "credit_score", "veh_cnt", "veh_own_cnt", "veh_lease_cnt",
    "veh_lien_cnt", "cnt_auto", "cnt_mtrcyc", "veh_w_coll_cnt", "veh_w_comp_cnt", "veh_w_ers_cnt", "drvr_cnt",
    "cnt_female", "cnt_male", "cnt_married", "cnt_single", "cnt_yth", "min_age", "avg_age", "max_age", "hoh_age",
    "min_mon_lic", "avg_mon_lic", "max_mon_lic", "hoh_mon_lic", "cnt_minr_viol", "avg_minr_viol", "cnt_majr_viol",
    "avg_majr_viol", "cnt_lic_susp", "fire_ind", "homeowner_ind", "curnt_bi_low", "curnt_bi_upp",
)


def _summary_sql(source, cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS min,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
            round(avg({c}), 6) AS mean,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3,
            CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER ({c} IS NULL) AS n_null FROM {source}"""
        for c in cols
    )


@query("column_summary", "D1", with_views(_summary_sql("predictors", _SUMMARY_COLS)))
def column_summary(spark, sf_dir):
    table = quality.summarize_columns(v.predictors(spark, sf_dir), _SUMMARY_COLS)
    return _rounded(table, 6, "q1", "median", "mean", "q3")


@query(
    "column_summary_losses",
    "D1",
    with_views(_summary_sql("loss_run_primary", ("paid_loss", "reserve_loss"))),
)
def column_summary_losses(spark, sf_dir):
    run = v.loss_run_primary(spark, sf_dir)
    table = quality.summarize_columns(run, ("paid_loss", "reserve_loss"))
    return _rounded(table, 6, "q1", "median", "mean", "q3")


def _date_summary_sql(source, cols):
    day = "date_diff('day', DATE '1970-01-01', {})"
    facts = {"min": "min({})", "q1": "quantile_cont({}, 0.25)", "median": "quantile_cont({}, 0.5)", "mean": "avg({})",
             "q3": "quantile_cont({}, 0.75)", "max": "max({})"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, " + ", ".join(
            f"CAST(DATE '1970-01-01' + CAST(floor(round({f.format(f'CAST({day.format(c)} AS DOUBLE)')}, 9)) AS INTEGER) AS VARCHAR) AS {n}"
            for n, f in facts.items()) + f", count(*) FILTER ({c} IS NULL) AS n_null FROM {source}"
        for c in cols)


@query("date_summary", "D1", with_views(_date_summary_sql("loss_run_primary", ("loss_date", "evaluation_date"))))
def date_summary(spark, sf_dir):
    """Range and quartiles of the dates of a loss run."""
    table = quality.summarize_dates(v.loss_run_primary(spark, sf_dir), ["loss_date", "evaluation_date"])
    return table.select("name", *[F.col(c).cast("string").alias(c) for c in table.columns[1:-1]], "n_null")


_LEVEL_COLS = ("zipcode", "curnt_insurer", "hoh_married", "veh_cnt")


@query(
    "level_summary",
    "D1 D14",
    with_views(f"""
        WITH t AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS level FROM predictors" for c in _LEVEL_COLS)}),
        n AS (SELECT name, level, count(*) AS n_rows FROM t WHERE level IS NOT NULL GROUP BY 1, 2),
        w AS (SELECT name, count(DISTINCT level) AS n_levels, count(level) AS n_valued, count(*) - count(level) AS n_null FROM t GROUP BY 1),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY n_rows DESC, level) AS INTEGER) AS place FROM n)
        SELECT r.name, place, level, n_rows, round(n_rows / CAST(n_valued AS DOUBLE), 8) AS share, n_levels, n_null
        FROM r JOIN w ON r.name = w.name WHERE place <= 6"""),
)
def level_summary(spark, sf_dir):
    """The commonest levels of text, flag and count columns."""
    return _rounded(quality.summarize_levels(v.predictors(spark, sf_dir), _LEVEL_COLS), 8, "share")


@query(
    "null_profile",
    "D2 A15",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS n_null,
            round(count(*) FILTER ({c} IS NULL) / CAST(count(*) AS DOUBLE), 6) AS share_null
            FROM predictors"""
            for c in ("hhld_id", "prior_bi", "time_w_carr", "credit_score", "veh_lien_cnt")
        )
    ),
)
def null_profile(spark, sf_dir):
    cols = ["hhld_id", "prior_bi", "time_w_carr", "credit_score", "veh_lien_cnt"]
    return _rounded(quality.null_profile(v.predictors(spark, sf_dir), cols), 6, "share_null")


@query(
    "null_patterns",
    "D3",
    with_views("""
        SELECT curnt_insurer, CAST(prior_bi IS NULL AS INTEGER) AS prior_bi_missing,
               CAST(time_w_carr IS NULL AS INTEGER) AS time_w_carr_missing,
               CAST(credit_score IS NULL AS INTEGER) AS credit_score_missing, count(*) AS n_rows
        FROM predictors GROUP BY ALL"""),
)
def null_patterns(spark, sf_dir):
    return quality.null_patterns(
        v.predictors(spark, sf_dir), ["prior_bi", "time_w_carr", "credit_score"], ["curnt_insurer"]
    )


@query(
    "ratio_reconciles",
    "D4 F8",
    with_views("""
        SELECT hhld_id, round(loss_ratio, 6) AS loss_ratio, round(ratio_gap, 6) AS ratio_gap
        FROM (SELECT hhld_id, loss_amount, premium,
                loss_ratio + (hhld_id % 13) * CAST(0.0001 AS DOUBLE) AS loss_ratio,
                loss_amount / premium - (loss_ratio + (hhld_id % 13) * CAST(0.0001 AS DOUBLE))
                  AS ratio_gap
              FROM outcomes)
        WHERE round_even(ratio_gap, 3) <> 0"""),
)
def ratio_reconciles(spark, sf_dir):
    noisy = v.outcomes(spark, sf_dir).withColumn(
        "loss_ratio", F.col("loss_ratio") + (F.col("hhld_id") % 13) * F.lit(0.0001)
    )
    found = quality.check_ratio(noisy, "loss_amount", "premium", "loss_ratio", 3)
    return _rounded(found.select("hhld_id", "loss_ratio", "ratio_gap"), 6, "loss_ratio", "ratio_gap")


# The four reconciliations of parts with their total.
_PARTS = {
    "vehicles_by_ownership": (("veh_own_cnt", "veh_lease_cnt", "veh_lien_cnt"), "veh_cnt"),
    "vehicles_by_kind": (("cnt_auto", "cnt_mtrcyc"), "veh_cnt"),
    "drivers_by_sex": (("cnt_female", "cnt_male"), "drvr_cnt"),
    "drivers_by_marital_status": (("cnt_married", "cnt_single"), "drvr_cnt"),
}


def _register_parts(name, parts, total):
    """Rows whose parts do not add up, on counts of which every 13th is made wrong by one."""
    gap = f"{total} - ({' + '.join(parts)})"

    @query(
        f"{name}_add_up",
        "D5",
        with_views(f"""
            SELECT hhld_id, {", ".join(parts)}, {total}, {gap} AS sum_gap
            FROM (SELECT * REPLACE (CAST({total} + CASE WHEN hhld_id % 13 = 0 THEN 1 ELSE 0 END AS INTEGER)
                                    AS {total}) FROM predictors)
            WHERE {gap} <> 0"""),
    )
    def parts_add_up(spark, sf_dir):
        wrong = F.when(F.col("hhld_id") % 13 == 0, 1).otherwise(0)
        df = v.predictors(spark, sf_dir).select(
            "hhld_id", *parts, (F.col(total) + wrong).cast("int").alias(total)
        )
        return quality.check_sum(df, list(parts), total)


for _name, (_parts, _total) in _PARTS.items():
    _register_parts(_name, _parts, _total)


@query(
    "implied_component_counts",
    "D6",
    with_views("""
        SELECT veh_cnt - (veh_own_cnt + veh_lease_cnt) AS implied_lien, count(*) AS n_rows
        FROM predictors WHERE veh_lien_cnt IS NULL GROUP BY 1"""),
)
def implied_component_counts(spark, sf_dir):
    unknown = v.predictors(spark, sf_dir).filter(F.col("veh_lien_cnt").isNull())
    implied = quality.implied_component(
        unknown, ["veh_own_cnt", "veh_lease_cnt"], "veh_cnt", "implied_lien"
    )
    return quality.value_counts(implied, ["implied_lien"])


@query(
    "columns_identical",
    "D7",
    with_views("""
        SELECT max(abs(curnt_bi_low - curnt_bi_upp)) AS max_abs_diff,
               CAST(0 AS DOUBLE) AS mean_rel_diff, CAST(0 AS BIGINT) AS n_null_mismatch,
               sum(abs(curnt_bi_low - curnt_bi_upp)) = 0 AS is_equal
        FROM (SELECT CAST(curnt_bi_low AS DOUBLE) AS curnt_bi_low,
                     CAST(curnt_bi_upp AS DOUBLE) AS curnt_bi_upp FROM predictors)"""),
)
def columns_identical(spark, sf_dir):
    return quality.check_equal(v.predictors(spark, sf_dir), "curnt_bi_low", "curnt_bi_upp")


@query(
    "column_ratio_counts",
    "D7 A1",
    with_views("""
        SELECT round_even(CAST(prior_bi AS DOUBLE) / curnt_bi_low, 6) AS ratio, count(*) AS n_rows
        FROM predictors GROUP BY 1"""),
)
def column_ratio_counts(spark, sf_dir):
    return quality.ratio_counts(v.predictors(spark, sf_dir), "prior_bi", "curnt_bi_low")


@query(
    "implausible_speed",
    "D8 K20",
    with_views("""
        SELECT trip_key, trip_distance_mi, trip_minutes,
               round(CASE WHEN trip_minutes > 0 THEN trip_distance_mi / (trip_minutes / 60) END, 6)
                 AS average_mph
        FROM trips_clean
        WHERE trip_distance_mi / nullif(trip_minutes / 60, 0) > 80
           OR (trip_minutes = 0 AND trip_distance_mi > 0)"""),
)
def implausible_speed(spark, sf_dir):
    found = reinsurance.speed_screen(_trips(spark, sf_dir), 80.0)
    return _rounded(
        found.select("trip_key", "trip_distance_mi", "trip_minutes", "average_mph"), 6, "average_mph"
    )


@query(
    "rate_above_limit",
    "D8",
    with_views("""
        SELECT hhld_id, round(CAST(veh_cnt AS DOUBLE) / drvr_cnt, 6) AS rate
        FROM predictors WHERE CAST(veh_cnt AS DOUBLE) / drvr_cnt > 2"""),
)
def rate_above_limit(spark, sf_dir):
    found = quality.check_rate(v.predictors(spark, sf_dir), "veh_cnt", "drvr_cnt", 2.0)
    return _rounded(found.select("hhld_id", "rate"), 6, "rate")


@query(
    "evaluated_before_loss",
    "D9",
    with_views("""
        SELECT claim_number, CAST(loss_date AS VARCHAR) AS loss_date,
               CAST(evaluation_date AS VARCHAR) AS evaluation_date
        FROM excess_named WHERE evaluation_date < loss_date"""),
)
def evaluated_before_loss(spark, sf_dir):
    run = reinsurance.clean_excess_names(v.loss_run_excess(spark, sf_dir))
    found = quality.check_order(run, "loss_date", "evaluation_date")
    return found.select(
        "claim_number", *[F.col(c).cast("string").alias(c) for c in ("loss_date", "evaluation_date")]
    )


@query(
    "keys_with_several_features",
    "D10",
    with_views("""
        SELECT claim_number, claimant_name, coverage, period,
               count(DISTINCT feature_identifier) AS n_distinct
        FROM loss_run_primary GROUP BY claim_number, claimant_name, coverage, loss_date, period
        HAVING count(DISTINCT feature_identifier) > 1"""),
)
def keys_with_several_features(spark, sf_dir):
    found = quality.check_subkeys(
        v.loss_run_primary(spark, sf_dir), reinsurance.PRIMARY_KEYS, "feature_identifier"
    )
    return found.drop("loss_date")


@query(
    "out_of_scope_losses",
    "D11",
    with_views("""
        SELECT claim_number, feature_identifier, period, round(incurred_loss, 4) AS incurred_loss
        FROM valued_primary WHERE period <> 'Transporting Rider' AND incurred_loss > 0"""),
)
def out_of_scope_losses(spark, sf_dir):
    found = quality.check_scope(
        _primary(spark, sf_dir), "period", ["Transporting Rider"], "incurred_loss"
    )
    return _rounded(
        found.select("claim_number", "feature_identifier", "period", "incurred_loss"),
        4,
        "incurred_loss",
    )


@query(
    "losses_at_policy_limit",
    "D12",
    with_views("""
        SELECT claim_number, claimant_name, feature_identifier, round(incurred_loss, 4) AS incurred_loss
        FROM flagged_primary WHERE is_latest = 1 AND incurred_loss >= 1000000"""),
)
def losses_at_policy_limit(spark, sf_dir):
    found = quality.check_cap(
        _primary(spark, sf_dir),
        "incurred_loss",
        1_000_000.0,
        reinsurance.PRIMARY_KEYS,
        "evaluation_date",
    )
    return _rounded(
        found.select("claim_number", "claimant_name", "feature_identifier", "incurred_loss"),
        4,
        "incurred_loss",
    )


@query(
    "grain_test",
    "D13",
    with_views("""
        SELECT count(*) AS n_rows, count(DISTINCT (hhld_id, clm_dates)) AS n_keys,
               count(*) = count(DISTINCT (hhld_id, clm_dates)) AS is_grain FROM claims"""),
)
def grain_test(spark, sf_dir):
    return quality.check_grain(v.claims(spark, sf_dir), ["hhld_id", "clm_dates"])


@query(
    "category_inventory",
    "D14",
    with_views("SELECT curnt_insurer, count(*) AS n_rows FROM predictors GROUP BY curnt_insurer"),
)
def category_inventory(spark, sf_dir):
    return quality.value_counts(v.predictors(spark, sf_dir), ["curnt_insurer"])


@query(
    "zip_concentration",
    "D15 L2 H8",
    with_views("""
        SELECT lpad(zipcode, 5, '0') AS zipcode, count(*) AS n_rows FROM predictors GROUP BY 1"""),
)
def zip_concentration(spark, sf_dir):
    zips = v.predictors(spark, sf_dir).select(sem.pad_zero("zipcode", 5).alias("zipcode"))
    return quality.value_counts(zips, ["zipcode"])


# --------------------------------------------------------- share tables


@query(
    "share_of_total",
    "A7",
    with_views("""
        SELECT curnt_insurer, count(*) AS n_rows,
               round(count(*) / CAST((SELECT count(*) FROM predictors) AS DOUBLE), 6) AS share
        FROM predictors GROUP BY curnt_insurer"""),
)
def share_of_total(spark, sf_dir):
    table = dist.value_shares(v.predictors(spark, sf_dir), ["curnt_insurer"])
    return _rounded(table, 6, "share")


@query(
    "two_way_shares",
    "A8 H7",
    with_views("""
        SELECT fire_ind, homeowner_ind, count(*) AS n_rows,
               round(count(*) / CAST((SELECT count(*) FROM predictors) AS DOUBLE), 6) AS share
        FROM predictors GROUP BY 1, 2"""),
)
def two_way_shares(spark, sf_dir):
    table = dist.value_shares(v.predictors(spark, sf_dir), ["fire_ind", "homeowner_ind"])
    return _rounded(table, 6, "share")


# ----------------------------------------------------------- histograms


def _bins_sql(source, col, bins, by=(), share=None):
    """Equal-width histogram with empty bins, as SQL."""
    keys = "".join(f"{b}, " for b in by)
    groups = f"SELECT DISTINCT {', '.join(by)} FROM h" if by else "SELECT 1 AS one"
    match = "".join(f"h.{b} IS NOT DISTINCT FROM s.{b} AND " for b in by)
    picked = "".join(f"s.{b}, " for b in by)
    total = {
        None: "",
        "all": ", round(coalesce(n, 0) / CAST((SELECT sum(n) FROM h) AS DOUBLE), 6) AS share",
        "group": ", round(coalesce(n, 0) / CAST((SELECT sum(n) FROM h g WHERE "
        + " AND ".join(f"g.{b} = s.{b}" for b in by)
        + ") AS DOUBLE), 6) AS share",
    }[share]
    return f"""
        WITH x AS (SELECT {keys}CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL),
        r AS (SELECT min(x) AS lo, (max(x) - min(x)) / CAST({bins} AS DOUBLE) AS step FROM x),
        h AS (SELECT {keys}least(CAST(floor((x - lo) / step) AS BIGINT), {bins - 1}) AS bin,
                     count(*) AS n FROM x, r GROUP BY ALL),
        s AS (SELECT * FROM ({groups}) g, (SELECT CAST(range AS BIGINT) AS bin FROM range({bins})) b)
        SELECT {picked}s.bin, round(lo + s.bin * step, 6) AS bin_start,
               round(lo + (s.bin + 1) * step, 6) AS bin_end, coalesce(n, 0) AS n_rows{total}
        FROM r, s LEFT JOIN h ON {match}h.bin = s.bin"""


@query("histogram_30_bins", "H1", with_views(_bins_sql("claims", "pd_amt", 30)))
def histogram_30_bins(spark, sf_dir):
    return _rounded(
        dist.histogram(v.claims(spark, sf_dir), "pd_amt"), 6, "bin_start", "bin_end"
    )


@query(
    "histogram_share_of_all",
    "H2",
    with_views(_bins_sql("predictors", "credit_score", 30, share="all")),
)
def histogram_share_of_all(spark, sf_dir):
    table = dist.histogram(v.predictors(spark, sf_dir), "credit_score", share="all")
    return _rounded(_rounded(table, 6, "bin_start", "bin_end"), 6, "share")


@query(
    "histogram_fixed_width",
    "H3 K22",
    with_views("""
        SELECT CAST(floor(incurred_loss / 100000) AS BIGINT) AS bin,
               floor(incurred_loss / 100000) * 100000 AS bin_start,
               (floor(incurred_loss / 100000) + 1) * 100000 AS bin_end, count(*) AS n_rows,
               round(count(*) / CAST((SELECT count(*) FROM flagged_primary WHERE is_latest = 1)
                                     AS DOUBLE), 6) AS share
        FROM flagged_primary WHERE is_latest = 1 GROUP BY 1, 2, 3"""),
)
def histogram_fixed_width(spark, sf_dir):
    latest = _latest(spark, sf_dir, "incurred_loss")
    return _rounded(
        dist.histogram(latest, "incurred_loss", width=100_000, share="all"), 6, "share"
    )


@query(
    "histogram_by_group",
    "H4",
    with_views(_bins_sql("claims", "pd_amt", 20, by=("aft_ind",), share="group")),
)
def histogram_by_group(spark, sf_dir):
    table = dist.histogram(
        v.claims(spark, sf_dir), "pd_amt", bins=20, by=["aft_ind"], share="group"
    )
    return _rounded(_rounded(table, 6, "bin_start", "bin_end"), 6, "share")


@query(
    "histogram_two_facets",
    "H4 K22",
    with_views(
        _bins_sql(
            "(SELECT * FROM flagged_primary WHERE is_latest = 1)",
            "incurred_loss",
            10,
            by=("coverage", "period"),
            share="all",
        )
    ),
)
def histogram_two_facets(spark, sf_dir):
    latest = _latest(spark, sf_dir, "coverage", "period", "incurred_loss")
    table = dist.histogram(
        latest, "incurred_loss", bins=10, by=["coverage", "period"], share="all"
    )
    return _rounded(_rounded(table, 6, "bin_start", "bin_end"), 6, "share")


@query(
    "ridge_bins_by_category",
    "H5",
    with_views("""
        WITH u AS (SELECT demographic, drivers FROM (
                SELECT cnt_female AS female, cnt_male AS male, cnt_married AS married,
                       cnt_single AS single, cnt_yth AS yth FROM predictors)
              UNPIVOT (drivers FOR demographic IN (female, male, married, single, yth))),
        r AS (SELECT min(drivers) AS lo, (max(drivers) - min(drivers)) / CAST(5 AS DOUBLE) AS step
              FROM u),
        h AS (SELECT demographic, least(CAST(floor((drivers - lo) / step) AS BIGINT), 4) AS bin,
                     count(*) AS n FROM u, r GROUP BY ALL),
        s AS (SELECT demographic, CAST(range AS BIGINT) AS bin
              FROM (SELECT DISTINCT demographic FROM u), range(5))
        SELECT s.demographic, s.bin, coalesce(n, 0) AS n_rows,
               round(coalesce(n, 0) / CAST((SELECT max(n) FROM h g WHERE g.demographic = s.demographic)
                                           AS DOUBLE), 6) AS height
        FROM s LEFT JOIN h ON h.demographic = s.demographic AND h.bin = s.bin"""),
)
def ridge_bins_by_category(spark, sf_dir):
    columns = ["cnt_yth", "cnt_female", "cnt_male", "cnt_married", "cnt_single"]
    long = reshape.unpivot_family(
        v.predictors(spark, sf_dir), ["hhld_id"], r"_(.*)", "demographic", "drivers", columns
    )
    table = dist.binned_by_category(long, "demographic", "drivers", bins=5)
    return _rounded(table.select("demographic", "bin", "n_rows", "height"), 6, "height")


def _box_sql(source, col, by):
    return f"""
        WITH x AS (SELECT {by}, {col} AS x FROM {source} WHERE {col} IS NOT NULL),
        q AS (SELECT {by}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                     quantile_cont(x, 0.75) AS q3 FROM x GROUP BY {by}),
        f AS (SELECT x.{by}, x, q1, median, q3,
                     x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) AS inside
              FROM x JOIN q ON x.{by} = q.{by})
        SELECT {by}, round(min(x) FILTER (inside), 6) AS whisker_low, round(max(q1), 6) AS q1,
               round(max(median), 6) AS median, round(max(q3), 6) AS q3,
               round(max(x) FILTER (inside), 6) AS whisker_high,
               count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n_rows
        FROM f GROUP BY {by}"""


@query("box_statistics", "H6", with_views(_box_sql("trips_clean", "trip_fare", "risk_segment")))
def box_statistics(spark, sf_dir):
    table = dist.box_stats(_trips(spark, sf_dir), "trip_fare", ["risk_segment"])
    return _rounded(table, 6, "whisker_low", "q1", "median", "q3", "whisker_high")


@query(
    "box_statistics_limited",
    "H6 H9 K20",
    with_views(
        _box_sql(
            """(SELECT risk_segment, trip_distance_mi / ((trip_minutes + 0.5) / 60) AS mph
                FROM trips_clean WHERE trip_distance_mi / ((trip_minutes + 0.5) / 60) <= 100)""",
            "mph",
            "risk_segment",
        )
    ),
)
def box_statistics_limited(spark, sf_dir):
    speed = act.average_speed("trip_distance_mi", "trip_minutes", 0.5)
    timed = _trips(spark, sf_dir).withColumn("mph", speed)
    table = dist.box_stats(timed, "mph", ["risk_segment"], limits=(None, 100.0))
    return _rounded(table, 6, "whisker_low", "q1", "median", "q3", "whisker_high")


@query(
    "bars_by_category",
    "H8",
    with_views("""
        SELECT risk_segment, count(*) AS n_trips, round_even(sum(trip_distance_mi), 0) AS total_miles
        FROM trips_clean GROUP BY risk_segment"""),
)
def bars_by_category(spark, sf_dir):
    table = reinsurance.exposure(_trips(spark, sf_dir), by="risk_segment")
    return table.select("risk_segment", "n_trips", "total_miles").orderBy(
        *sem.descending("total_miles")
    )


@query(
    "histogram_limited_range",
    "H9",
    with_views(
        _bins_sql("(SELECT * FROM predictors WHERE avg_age BETWEEN 16 AND 70)", "avg_age", 10)
    ),
)
def histogram_limited_range(spark, sf_dir):
    table = dist.histogram(
        v.predictors(spark, sf_dir), "avg_age", bins=10, limits=(16.0, 70.0)
    )
    return _rounded(table, 6, "bin_start", "bin_end")


@query(
    "paired_measures",
    "H10 P1",
    with_views("""
        SELECT floor(premium / 10) * 10 AS x_start, floor(loss_amount / 500) * 500 AS y_start,
               count(*) AS n_rows
        FROM outcomes GROUP BY 1, 2"""),
)
def paired_measures(spark, sf_dir):
    return dist.paired_bins(v.outcomes(spark, sf_dir), "premium", "loss_amount", 10.0, 500.0)


# ---------------------------------------------------------------- series


@query(
    "monthly_claims",
    "T1 A11",
    with_views("""
        SELECT CAST(CAST(date_trunc('month', clm_dates) AS DATE) AS VARCHAR) AS month,
               count(*) AS n_claims, round(avg(pd_amt), 4) AS avg_severity
        FROM claims GROUP BY 1"""),
)
def monthly_claims(spark, sf_dir):
    series = timeseries.monthly(
        v.claims(spark, sf_dir),
        "clm_dates",
        {"n_claims": F.count("*"), "avg_severity": F.round(F.avg("pd_amt"), 4)},
    )
    return series.withColumn("month", F.col("month").cast("string"))


@query(
    "dense_monthly_series",
    "T2",
    with_views("""
        WITH m AS (SELECT coverage, CAST(date_trunc('month', evaluation_date) AS DATE) AS month,
                          count(*) AS n FROM loss_run_primary GROUP BY 1, 2),
        s AS (SELECT coverage, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))
                                    AS DATE) AS month FROM m GROUP BY coverage)
        SELECT s.coverage, CAST(s.month AS VARCHAR) AS month, n AS n_rows
        FROM s LEFT JOIN m ON m.coverage = s.coverage AND m.month = s.month"""),
)
def dense_monthly_series(spark, sf_dir):
    run = v.loss_run_primary(spark, sf_dir)
    series = timeseries.monthly(run, "evaluation_date", {"n_rows": F.count("*")}, ["coverage"])
    dense = timeseries.month_spine(series, by=["coverage"])
    return dense.withColumn("month", F.col("month").cast("string"))


def _decompose_sql(measure):
    return f"""
        WITH m AS (SELECT CAST(date_trunc('month', clm_dates) AS DATE) AS month, {measure} AS x
                   FROM claims WHERE clm_dates < DATE '2001-01-01' GROUP BY 1),
        t AS (SELECT month, x,
                CASE WHEN count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
                  THEN (sum(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                        + 0.5 * lag(x, 6) OVER w + 0.5 * lead(x, 6) OVER w) / 12 END AS trend
              FROM m WINDOW w AS (ORDER BY month)),
        f AS (SELECT month(month) AS p, avg(x / trend) AS raw FROM t GROUP BY 1),
        s AS (SELECT p, raw / (SELECT avg(raw) FROM f) AS seasonal FROM f)
        SELECT CAST(month AS VARCHAR) AS month, round(x, 4) AS x, round(trend, 4) AS trend,
               round(seasonal, 6) AS seasonal, round(x / (trend * seasonal), 6) AS remainder
        FROM t JOIN s ON s.p = month(t.month)"""


def _decomposed(spark, sf_dir, measure):
    early = v.claims(spark, sf_dir).filter(F.col("clm_dates") < F.lit(v.AS_OF))
    parts = timeseries.decompose(
        timeseries.monthly(early, "clm_dates", {"x": measure}), "month", "x"
    )
    rounded = _rounded(_rounded(parts, 4, "x", "trend"), 6, "seasonal", "remainder")
    return rounded.withColumn("month", F.col("month").cast("string"))


@query("decompose_claim_counts", "T3 W5", with_views(_decompose_sql("CAST(count(*) AS DOUBLE)")))
def decompose_claim_counts(spark, sf_dir):
    return _decomposed(spark, sf_dir, F.count("*").cast("double"))


@query("decompose_severity", "T3", with_views(_decompose_sql("avg(pd_amt)")))
def decompose_severity(spark, sf_dir):
    return _decomposed(spark, sf_dir, F.avg("pd_amt"))


@query(
    "clean_predictors_have_no_nulls",
    "D2 E1",
    with_views("""
        SELECT count(*) FILTER (veh_lien_cnt IS NULL OR time_w_carr IS NULL OR prior_bi IS NULL
                                OR credit_score IS NULL) AS n_null, count(*) AS n_rows FROM filled"""),
)
def clean_predictors_have_no_nulls(spark, sf_dir):
    filled = households.impute_predictors(v.predictors(spark, sf_dir))
    broken = quality.any_null(["veh_lien_cnt", "time_w_carr", "prior_bi", "credit_score"])
    return filled.agg(F.count_if(broken).alias("n_null"), F.count("*").alias("n_rows"))
