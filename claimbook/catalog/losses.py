"""Reinsured losses, exposure, loss cost and frequency."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimbook.catalog import views as v
from claimbook.catalog.registry import query
from claimbook.catalog.views import VALUATION_YEAR, with_views
from claimbook.operators import distributions as dist
from claimbook.plans import reinsurance as re
from claimbook.sources.scratch import materialize, shared_folder


def _primary(spark, sf_dir):
    return re.value_losses(v.loss_run_primary(spark, sf_dir), *re.PRIMARY_LAYER)


def _excess_named(spark, sf_dir):
    return re.clean_excess_names(v.loss_run_excess(spark, sf_dir))


def _excess(spark, sf_dir):
    return re.value_losses(_excess_named(spark, sf_dir), *re.EXCESS_LAYER, floor_at_zero=False)


def _trips(spark, sf_dir):
    return re.clean_trips(v.trips(spark, sf_dir))


def _latest(spark, sf_dir, *cols):
    """Latest-valuation rows, written once because a histogram reads them twice."""
    developed = re.develop(v.loss_run_primary(spark, sf_dir))
    return materialize(developed.filter("is_latest = 1").select(*cols))


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _money(df):
    return _rounded(df, 3, *[c for c in ("total_incurred", "total_ceded") if c in df.columns])


_ROW_COLUMNS = (
    "claim_number",
    "feature_identifier",
    "incurred_loss",
    "ceded_loss",
    "is_ceded",
    "maturity",
    "maturity_bucket",
    "accident_year",
)


@query(
    "layered_losses",
    "K1 K2 K3 K4 K5 K6",
    with_views("""
        SELECT claim_number, feature_identifier, round(incurred_loss, 4) AS incurred_loss,
               round(ceded_loss, 4) AS ceded_loss, is_ceded, maturity, maturity_bucket, accident_year
        FROM valued_primary"""),
)
def layered_losses(spark, sf_dir):
    rows = _primary(spark, sf_dir).select(*_ROW_COLUMNS)
    return _rounded(rows, 4, "incurred_loss", "ceded_loss")


@query(
    "layered_losses_excess",
    "K1 K2 K4 K5 K6 P6",
    with_views("""
        SELECT claim_number, period, CAST(evaluation_date AS VARCHAR) AS evaluation_date,
               round(incurred_loss, 4) AS incurred_loss, round(ceded_loss, 4) AS ceded_loss,
               maturity, maturity_bucket, accident_year
        FROM valued_excess"""),
)
def layered_losses_excess(spark, sf_dir):
    rows = _excess(spark, sf_dir).select(
        "claim_number",
        "period",
        F.col("evaluation_date").cast("string").alias("evaluation_date"),
        "incurred_loss",
        "ceded_loss",
        "maturity",
        "maturity_bucket",
        "accident_year",
    )
    return _rounded(rows, 4, "incurred_loss", "ceded_loss")


@query(
    "developed_losses",
    "K7 W1 W2",
    with_views("""
        SELECT claim_number, claimant_name, feature_identifier, maturity, maturity_bucket, is_latest,
               is_first FROM flagged_primary"""),
)
def developed_losses(spark, sf_dir):
    return re.develop(v.loss_run_primary(spark, sf_dir)).select(
        "claim_number",
        "claimant_name",
        "feature_identifier",
        "maturity",
        "maturity_bucket",
        "is_latest",
        "is_first",
    )


@query(
    "report_lag",
    "K8",
    with_views("""
        SELECT period, round(avg(maturity), 6) AS avg_maturity, count(*) AS n_rows
        FROM flagged_excess WHERE is_first = 1 AND maturity >= 0 GROUP BY period"""),
)
def report_lag(spark, sf_dir):
    table = re.report_lag(_excess(spark, sf_dir))
    return _rounded(table, 6, "avg_maturity")


def _fixes(spark, sf_dir):
    """Suggested loss dates, written once because each run is corrected with them."""
    return materialize(re.suggest_corrections(_excess_named(spark, sf_dir)))


def _moved(spark, sf_dir):
    """The excess run with the suggested loss dates."""
    return re.correct_dates(_excess_named(spark, sf_dir), _fixes(spark, sf_dir))


@query(
    "corrected_loss_dates",
    "K9 K7 X8",
    with_views("""
        SELECT claim_number, period, CAST(loss_date AS VARCHAR) AS loss_date,
               CAST(evaluation_date AS VARCHAR) AS evaluation_date, maturity, is_latest, is_first
        FROM flagged_moved"""),
)
def corrected_loss_dates(spark, sf_dir):
    developed = re.develop(
        _moved(spark, sf_dir), re.EXCESS_KEYS, *re.EXCESS_LAYER, floor_at_zero=False
    )
    return developed.select(
        "claim_number",
        "period",
        F.col("loss_date").cast("string").alias("loss_date"),
        F.col("evaluation_date").cast("string").alias("evaluation_date"),
        "maturity",
        "is_latest",
        "is_first",
    )


@query(
    "covered_periods",
    "K10 F5",
    with_views("""
        SELECT period, count(*) AS n_rows, round(sum(paid_loss), 3) AS total_paid FROM excess_named
        WHERE period = 'Transporting Rider' OR period = 'En Route To Pickup' GROUP BY period"""),
)
def covered_periods(spark, sf_dir):
    return re.covered(_excess_named(spark, sf_dir)).groupBy("period").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("paid_loss"), 3).alias("total_paid")
    )


@query(
    "claimants_per_claim",
    "K11 A5",
    with_views("""
        SELECT claim_number, count(DISTINCT claimant_name) AS n_claimants
        FROM loss_run_primary GROUP BY claim_number"""),
)
def claimants_per_claim(spark, sf_dir):
    return re.claimants(v.loss_run_primary(spark, sf_dir))


@query(
    "claimants_per_claim_period_coverage",
    "K11",
    with_views("""
        SELECT claim_number, period, coverage, count(DISTINCT claimant_name) AS n_claimants
        FROM loss_run_primary GROUP BY claim_number, period, coverage"""),
)
def claimants_per_claim_period_coverage(spark, sf_dir):
    run = v.loss_run_primary(spark, sf_dir)
    return re.claimants(run, ["claim_number", "period", "coverage"])


@query(
    "latest_diagonal_by_coverage",
    "K12",
    with_views("""
        SELECT accident_year, coverage, maturity_bucket, round(sum(incurred_loss), 3) AS total_incurred,
               round(sum(ceded_loss), 3) AS total_ceded, count(*) AS claim_count
        FROM flagged_primary WHERE is_latest = 1 GROUP BY 1, 2, 3"""),
)
def latest_diagonal_by_coverage(spark, sf_dir):
    table = re.latest_diagonal(
        _primary(spark, sf_dir), by=["accident_year", "coverage", "maturity_bucket"]
    )
    return _money(table)


def _parted_runs(spark, sf_dir):
    """The primary run as three that arrive one after another; claims, and dates of a claim, overlap."""
    rows = _primary(spark, sf_dir)
    part = F.pmod(F.crc32(F.col("feature_identifier").cast("binary")), F.lit(3))
    return [rows.filter(part == i) for i in range(3)]


def _stored(spark, sf_dir, count_rule="rows"):
    store = re.diagonal_store(spark, shared_folder(spark), count_rule=count_rule)
    for i, run in enumerate(_parted_runs(spark, sf_dir)):
        store.add(f"run {i}", run)
    store.forget_old()
    return store


_STORED_SQL = """
        SELECT claim_number, claimant_name, coverage, CAST(loss_date AS VARCHAR) AS loss_date, period,
               CAST(max(evaluation_date) AS VARCHAR) AS evaluation_date,
               round(sum(incurred_loss), 3) AS incurred, round(sum(ceded_loss), 3) AS ceded, count(*) AS claims
        FROM flagged_primary WHERE {} = 1 GROUP BY 1, 2, 3, 4, 5"""


def _shown_totals(table):
    return table.withColumns({
        "loss_date": F.col("loss_date").cast("string"), "evaluation_date": F.col("evaluation_date").cast("string"),
        "incurred": F.round("incurred", 3), "ceded": F.round("ceded", 3)})


@query("stored_latest_totals", "W3 K12", with_views(_STORED_SQL.format("is_latest")))
def stored_latest_totals(spark, sf_dir):
    """Latest totals per claim from a state that three runs were merged into."""
    return _shown_totals(_stored(spark, sf_dir).totals("latest"))


@query("stored_first_totals", "W4 K8", with_views(_STORED_SQL.format("is_first")))
def stored_first_totals(spark, sf_dir):
    return _shown_totals(_stored(spark, sf_dir).totals("first"))


@query(
    "stored_latest_diagonal",
    "K13 K12",
    with_views("""
        SELECT accident_year, coverage, maturity_bucket, round(sum(incurred_loss), 3) AS total_incurred,
               round(sum(ceded_loss), 3) AS total_ceded, CAST(sum(is_ceded) AS BIGINT) AS claim_count
        FROM flagged_primary WHERE is_latest = 1 GROUP BY 1, 2, 3"""),
)
def stored_latest_diagonal(spark, sf_dir):
    """The diagonal of three runs, from their merged state."""
    totals = _stored(spark, sf_dir, "ceded").totals()
    return _money(re.diagonal_table(totals, ["accident_year", "coverage", "maturity_bucket"]))


_PRIMARY_DIAGONAL = """
        SELECT 'Data1 - $1M Lim' AS data_source, accident_year, maturity_bucket,
               sum(incurred_loss) AS total_incurred, sum(ceded_loss) AS total_ceded,
               CAST(sum(is_ceded) AS BIGINT) AS claim_count
        FROM flagged_primary WHERE is_latest = 1 GROUP BY 2, 3"""
_EXCESS_DIAGONAL = """
        SELECT 'Data2 - $1M XS $1M' AS data_source, accident_year, maturity_bucket,
               sum(incurred_loss) AS total_incurred, sum(ceded_loss) AS total_ceded,
               count(*) AS claim_count
        FROM flagged_moved WHERE is_latest = 1
          AND period IN ('Transporting Rider', 'En Route To Pickup') GROUP BY 2, 3"""


def _diagonals(spark, sf_dir, by=("accident_year", "maturity_bucket")):
    first = re.latest_diagonal(
        _primary(spark, sf_dir), re.PRIMARY_KEYS, by, "ceded", re.PRIMARY_SOURCE
    )
    moved = re.value_losses(_moved(spark, sf_dir), *re.EXCESS_LAYER, floor_at_zero=False)
    second = re.latest_diagonal(re.covered(moved), re.EXCESS_KEYS, by, "rows", re.EXCESS_SOURCE)
    return first, second


@query(
    "latest_diagonal_by_source",
    "K13 P10",
    with_views(f"""
        SELECT * REPLACE (round(total_incurred, 3) AS total_incurred,
                          round(total_ceded, 3) AS total_ceded)
        FROM ({_PRIMARY_DIAGONAL} UNION ALL {_EXCESS_DIAGONAL})"""),
)
def latest_diagonal_by_source(spark, sf_dir):
    first, second = _diagonals(spark, sf_dir)
    return _money(first.unionByName(second))


_COMBINED = f"""
        SELECT accident_year, maturity_bucket, sum(total_ceded) AS total_ceded,
               CAST(sum(claim_count) AS BIGINT) AS claim_count
        FROM ({_PRIMARY_DIAGONAL} UNION ALL {_EXCESS_DIAGONAL})
        GROUP BY 1, 2 HAVING sum(claim_count) > 0"""


@query(
    "combined_ceded_losses",
    "K14 U1 F7",
    with_views(f"SELECT * REPLACE (round(total_ceded, 3) AS total_ceded) FROM ({_COMBINED})"),
)
def combined_ceded_losses(spark, sf_dir):
    return _money(re.combine_runs(*_diagonals(spark, sf_dir)))


@query("cleaned_trips", "K15 F6 X10 X15", with_views("""
        SELECT trip_key, trip_status, risk_segment,
               strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, trip_distance_mi, trip_fare,
               trip_minutes FROM trips_clean"""))
def cleaned_trips(spark, sf_dir):
    return _trips(spark, sf_dir).select(
        "trip_key",
        "trip_status",
        "risk_segment",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        "trip_distance_mi",
        "trip_fare",
        "trip_minutes",
    )


_EXPOSURE = """
        SELECT CAST(year(start_time) AS INTEGER) AS trip_year,
               round_even(sum(trip_distance_mi), 0) AS total_miles, count(*) AS n_trips,
               count(DISTINCT month(start_time)) AS n_exposure_months
        FROM trips_clean GROUP BY 1"""


@query("exposure_by_year", "K16", with_views(_EXPOSURE))
def exposure_by_year(spark, sf_dir):
    return re.exposure(_trips(spark, sf_dir))


@query(
    "exposure_by_segment",
    "K17",
    with_views("""
        SELECT risk_segment, count(*) AS n_trips, round_even(sum(trip_distance_mi), 0) AS total_miles
        FROM trips_clean GROUP BY risk_segment"""),
)
def exposure_by_segment(spark, sf_dir):
    table = re.exposure(_trips(spark, sf_dir), "risk_segment")
    return table.select("risk_segment", "n_trips", "total_miles")


@query(
    "loss_cost_by_maturity",
    "K18 J2",
    with_views(f"""
        WITH c AS ({_COMBINED}), e AS ({_EXPOSURE})
        SELECT c.accident_year, maturity_bucket, round(total_ceded, 3) AS total_ceded, claim_count,
               total_miles, n_exposure_months,
               round_even(total_ceded / nullif(total_miles, 0), 2) AS ceded_loss_cost,
               round(claim_count / nullif(total_miles, 0), 8) AS ceded_frequency
        FROM c LEFT JOIN e ON c.accident_year = e.trip_year"""),
)
def loss_cost_by_maturity(spark, sf_dir):
    table = re.ceded_experience(
        v.loss_run_primary(spark, sf_dir),
        v.loss_run_excess(spark, sf_dir),
        v.trips(spark, sf_dir),
        _fixes(spark, sf_dir),
    )
    return _rounded(_money(table), 8, "ceded_frequency")


@query(
    "loss_cost_at_common_valuation",
    "K19",
    with_views(f"""
        WITH c AS (SELECT accident_year, sum(total_ceded) AS total_ceded,
                     CAST(sum(claim_count) AS BIGINT) AS claim_count
                   FROM ({_PRIMARY_DIAGONAL} UNION ALL {_EXCESS_DIAGONAL})
                   GROUP BY 1 HAVING sum(claim_count) > 0), e AS ({_EXPOSURE})
        SELECT c.accident_year, round(total_ceded, 3) AS total_ceded, claim_count,
               CAST({VALUATION_YEAR} - c.accident_year AS INTEGER) AS maturity,
               total_miles, n_exposure_months,
               round_even(total_ceded / nullif(total_miles, 0), 2) AS ceded_loss_cost,
               round(claim_count / nullif(total_miles, 0), 8) AS ceded_frequency
        FROM c LEFT JOIN e ON c.accident_year = e.trip_year"""),
)
def loss_cost_at_common_valuation(spark, sf_dir):
    table = re.ceded_experience(
        v.loss_run_primary(spark, sf_dir),
        v.loss_run_excess(spark, sf_dir),
        v.trips(spark, sf_dir),
        _fixes(spark, sf_dir),
        valuation_year=VALUATION_YEAR,
    )
    return _rounded(_money(table), 8, "ceded_frequency")


@query(
    "maturity_distribution_by_year",
    "K21 H4",
    with_views("""
        WITH l AS (SELECT accident_year, maturity FROM flagged_primary WHERE is_latest = 1),
        r AS (SELECT min(maturity) AS lo, (max(maturity) - min(maturity)) / CAST(20 AS DOUBLE) AS step
              FROM l),
        h AS (SELECT accident_year, least(CAST(floor((maturity - lo) / step) AS BIGINT), 19) AS bin,
                     count(*) AS n FROM l, r GROUP BY ALL),
        s AS (SELECT accident_year, CAST(range AS BIGINT) AS bin
              FROM (SELECT DISTINCT accident_year FROM l), range(20))
        SELECT s.accident_year, s.bin, coalesce(n, 0) AS n_rows
        FROM s LEFT JOIN h ON h.accident_year = s.accident_year AND h.bin = s.bin"""),
)
def maturity_distribution_by_year(spark, sf_dir):
    latest = _latest(spark, sf_dir, "accident_year", "maturity")
    table = dist.histogram(latest, "maturity", bins=20, by=["accident_year"])
    return table.select("accident_year", "bin", "n_rows")


@query(
    "incurred_ridges_by_year",
    "K22 H5",
    with_views("""
        WITH l AS (SELECT CAST(accident_year AS VARCHAR) AS accident_year, incurred_loss AS x
                   FROM flagged_primary WHERE is_latest = 1),
        r AS (SELECT min(x) AS lo, (max(x) - min(x)) / CAST(10 AS DOUBLE) AS step FROM l),
        h AS (SELECT accident_year, least(CAST(floor((x - lo) / step) AS BIGINT), 9) AS bin,
                     count(*) AS n FROM l, r GROUP BY ALL),
        s AS (SELECT accident_year, CAST(range AS BIGINT) AS bin
              FROM (SELECT DISTINCT accident_year FROM l), range(10))
        SELECT s.accident_year, s.bin, coalesce(n, 0) AS n_rows,
               round(coalesce(n, 0) / CAST((SELECT max(n) FROM h g
                     WHERE g.accident_year = s.accident_year) AS DOUBLE), 6) AS height
        FROM s LEFT JOIN h ON h.accident_year = s.accident_year AND h.bin = s.bin"""),
)
def incurred_ridges_by_year(spark, sf_dir):
    latest = _latest(spark, sf_dir, "accident_year", "incurred_loss")
    labelled = latest.withColumn("accident_year", F.col("accident_year").cast("string"))
    table = dist.binned_by_category(labelled, "accident_year", "incurred_loss", bins=10)
    return _rounded(table.select("accident_year", "bin", "n_rows", "height"), 6, "height")


def _latest_excess(spark, sf_dir, *cols):
    developed = re.develop(
        _moved(spark, sf_dir), re.EXCESS_KEYS, *re.EXCESS_LAYER, floor_at_zero=False
    )
    return materialize(developed.filter("is_latest = 1").select(*cols))


@query(
    "excess_incurred_distribution_by_period",
    "K22 H4",
    with_views("""
        WITH l AS (SELECT period, incurred_loss AS x FROM flagged_moved WHERE is_latest = 1),
        r AS (SELECT min(x) AS lo, (max(x) - min(x)) / CAST(10 AS DOUBLE) AS step FROM l),
        h AS (SELECT period, least(CAST(floor((x - lo) / step) AS BIGINT), 9) AS bin, count(*) AS n
              FROM l, r GROUP BY ALL),
        s AS (SELECT period, CAST(range AS BIGINT) AS bin FROM (SELECT DISTINCT period FROM l), range(10))
        SELECT s.period, s.bin, coalesce(n, 0) AS n_rows
        FROM s LEFT JOIN h ON h.period = s.period AND h.bin = s.bin"""),
)
def excess_incurred_distribution_by_period(spark, sf_dir):
    latest = _latest_excess(spark, sf_dir, "period", "incurred_loss")
    table = dist.histogram(latest, "incurred_loss", bins=10, by=["period"])
    return table.select("period", "bin", "n_rows")


@query(
    "excess_incurred_ridges_by_year",
    "K22 H5",
    with_views("""
        WITH l AS (SELECT CAST(accident_year AS VARCHAR) AS accident_year, incurred_loss AS x
                   FROM flagged_moved WHERE is_latest = 1 AND incurred_loss BETWEEN 0 AND 500000),
        r AS (SELECT min(x) AS lo, (max(x) - min(x)) / CAST(10 AS DOUBLE) AS step FROM l),
        h AS (SELECT accident_year, least(CAST(floor((x - lo) / step) AS BIGINT), 9) AS bin,
                     count(*) AS n FROM l, r GROUP BY ALL),
        s AS (SELECT accident_year, CAST(range AS BIGINT) AS bin
              FROM (SELECT DISTINCT accident_year FROM l), range(10))
        SELECT s.accident_year, s.bin, coalesce(n, 0) AS n_rows,
               round(coalesce(n, 0) / CAST((SELECT max(n) FROM h g
                     WHERE g.accident_year = s.accident_year) AS DOUBLE), 6) AS height
        FROM s LEFT JOIN h ON h.accident_year = s.accident_year AND h.bin = s.bin"""),
)
def excess_incurred_ridges_by_year(spark, sf_dir):
    latest = _latest_excess(spark, sf_dir, "accident_year", "incurred_loss")
    labelled = latest.withColumn("accident_year", F.col("accident_year").cast("string"))
    table = dist.binned_by_category(
        labelled, "accident_year", "incurred_loss", bins=10, limits=(0.0, 500_000.0)
    )
    return _rounded(table.select("accident_year", "bin", "n_rows", "height"), 6, "height")
