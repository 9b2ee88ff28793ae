"""Reinsured losses, exposure, loss cost and frequency."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimbook.functions import actuarial as act
from claimbook.functions.semantics import (
    as_column,
    composite_key,
    distinct_count,
    level_rank,
    round_even,
    safe_div,
)
from claimbook.operators.joins import join_keyed
from claimbook.operators.snapshot_state import SnapshotStore
from claimbook.operators.snapshots import flag_snapshots, totals_at

# Grouping keys of the two loss runs.
PRIMARY_KEYS = ("claim_number", "claimant_name", "coverage", "loss_date", "period")
EXCESS_KEYS = ("claim_number", "loss_date", "period")

# The reinsured layers as (attachment, limit).
PRIMARY_LAYER = (250_000.0, 1_250_000.0)
EXCESS_LAYER = (0.0, 500_000.0)

# Periods the excess policy covers, source tags, trip sentinels.
COVERED_PERIODS = ("Transporting Rider", "En Route To Pickup")
PRIMARY_SOURCE = "Data1 - $1M Lim"
EXCESS_SOURCE = "Data2 - $1M XS $1M"
CANCELED = "canceled"
UNKNOWN_SEGMENT = "\\N"

# Column names of the excess run and of the trips at ingest.
EXCESS_NAMES = {
    "Claim Number": "claim_number",
    "Loss Date": "loss_date",
    "Evaluation Date": "evaluation_date",
    "Paid Loss": "paid_loss",
    "Reserve Loss": "reserve_loss",
    "Period": "period",
}
TRIP_NAMES = {
    "a.trip_status": "trip_status",
    "b.risk_segment": "risk_segment",
    "a.begintrip_timestamp_local": "start_time",
    "a.endtrip_timestamp_local": "end_time",
    "c.distance_miles_p3": "trip_distance_mi",
    "c.trip_fare": "trip_fare",
}
TRIP_IDS = ("a.trip_identifier", "a.driver_identifier", "a.vehicle_identifier")


def _dated(df: DataFrame, null_to_open: bool) -> DataFrame:
    """Maturity, bucket and accident year from the two dates."""
    return df.withColumn("maturity", act.maturity("loss_date", "evaluation_date")).withColumns(
        {
            "maturity_bucket": act.maturity_bucket("maturity", null_to_open),
            "accident_year": F.year("loss_date"),
        }
    )


def value_losses(
    df: DataFrame,
    attachment: float,
    limit: float,
    floor_at_zero: bool = True,
    null_to_open: bool = False,
) -> DataFrame:
    """Row-wise part of a loss run: incurred, ceded, trigger, maturity, year.

    Narrow: one projection, no shuffle.
    """
    valued = df.withColumn("incurred_loss", act.incurred("paid_loss", "reserve_loss")).withColumns(
        {
            "ceded_loss": act.layer("incurred_loss", attachment, limit, floor_at_zero),
            "is_ceded": act.exceeds("incurred_loss", attachment),
        }
    )
    return _dated(valued, null_to_open)


def develop(
    df: DataFrame,
    keys: Sequence[str] = PRIMARY_KEYS,
    attachment: float = PRIMARY_LAYER[0],
    limit: float = PRIMARY_LAYER[1],
    floor_at_zero: bool = True,
    null_to_open: bool = False,
) -> DataFrame:
    """Row-level loss run with valuations and first/latest snapshot flags."""
    valued = value_losses(df, attachment, limit, floor_at_zero, null_to_open)
    return flag_snapshots(valued, list(keys), "evaluation_date")


def clean_excess_names(df: DataFrame) -> DataFrame:
    """Rename the blank-holding columns of the excess run."""
    return df.withColumnsRenamed(EXCESS_NAMES)


def correct_dates(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace the loss date of the listed claims.

    ``corrections`` has one row per ``claim_number`` with its ``loss_date``.
    Maturities and flags are derived afterwards, so the corrected date is also the
    date the snapshots are grouped by. The few corrections are broadcast if Spark's
    threshold allows it; beyond that a claim with many rows is split by the adaptive
    skew join.
    """
    fixes = corrections.select("claim_number", F.col("loss_date").alias("_fixed"))
    joined = df.join(fixes, "claim_number", "left").select(*df.columns, "_fixed")
    return joined.withColumn("loss_date", F.coalesce("_fixed", "loss_date")).drop("_fixed")


def suggest_corrections(
    df: DataFrame, keys: Sequence[str] = EXCESS_KEYS, lag_months: int = 5
) -> DataFrame:
    """Loss dates for claims evaluated before they happened.

    The proposal is the first evaluation less the usual report lag in calendar
    months.
    """
    first = df.groupBy(*keys).agg(F.min("evaluation_date").alias("_first"))
    broken = first.filter(F.col("_first") < F.col("loss_date"))
    return broken.groupBy("claim_number").agg(
        F.min(F.add_months("_first", -lag_months)).alias("loss_date")
    )


def covered(df: DataFrame, periods: Sequence[str] = COVERED_PERIODS) -> DataFrame:
    """Losses in the covered periods."""
    return df.filter(F.col("period").isin(list(periods)))


def _require_keys(by: Sequence[str], keys: Sequence[str]) -> None:
    """Refuse a breakdown finer than the snapshot groups: it would change them."""
    finer = [c for c in by if c not in keys]
    if finer:
        raise ValueError(f"{finer} are not among the snapshot keys {list(keys)}")


def report_lag(
    df: DataFrame, keys: Sequence[str] = EXCESS_KEYS, by: Sequence[str] = ("period",)
) -> DataFrame:
    """Mean maturity and row count at first evaluation, negative ages left out.

    ``by`` are grouping keys of the run. Sums and counts per group and date are
    combined before any group meets.
    """
    _require_keys(by, keys)
    at_first = totals_at(
        df,
        list(keys),
        "evaluation_date",
        {"_months": F.col("maturity"), "_rows": F.lit(1)},
        which="first",
    ).filter(F.datediff("evaluation_date", "loss_date") >= 0)
    return at_first.groupBy(*by).agg(
        safe_div(F.sum("_months"), F.sum("_rows")).alias("avg_maturity"),
        F.sum("_rows").alias("n_rows"),
    )


def claimants(df: DataFrame, by: Sequence[str] = ("claim_number",)) -> DataFrame:
    """Distinct claimants per claim (or finer), in no order; unknown counts as one."""
    return df.groupBy(*by).agg(
        distinct_count("claimant_name", count_null=True).alias("n_claimants")
    )


def latest_diagonal(
    df: DataFrame,
    keys: Sequence[str] = PRIMARY_KEYS,
    by: Sequence[str] = ("accident_year", "maturity_bucket"),
    count_rule: str = "rows",
    source: str | None = None,
    null_to_open: bool = False,
) -> DataFrame:
    """Incurred, ceded and count at each claim's latest valuation.

    ``df`` comes from ``value_losses``. ``count_rule`` is ``"rows"`` or
    ``"ceded"`` (rows that trigger the layer). Sums are combined per claim and
    date first, so no claim's rows are ever brought together; accident year and
    maturity bucket follow from the dates that survive.
    """
    by = list(by)
    _require_keys([c for c in by if c not in _DERIVED], keys)
    latest = totals_at(df, list(keys), "evaluation_date", diagonal_measures(count_rule))
    return diagonal_table(latest, by, source, null_to_open)


_DERIVED = {"accident_year", "maturity_bucket", "maturity"}


def diagonal_measures(count_rule: str = "rows") -> dict[str, Column]:
    """What a diagonal sums per claim, as expressions over ``value_losses`` rows."""
    if count_rule not in ("rows", "ceded"):
        raise ValueError("count_rule is 'rows' or 'ceded'")
    counted = F.col("is_ceded") if count_rule == "ceded" else F.lit(1)
    return {
        "incurred": F.col("incurred_loss"),
        "ceded": F.col("ceded_loss"),
        "claims": counted.cast("long"),
    }


def diagonal_table(
    latest: DataFrame,
    by: Sequence[str] = ("accident_year", "maturity_bucket"),
    source: str | None = None,
    null_to_open: bool = False,
) -> DataFrame:
    """Diagonal from totals per claim and its latest date, computed or taken from a stored state."""
    table = (
        _dated(latest, null_to_open)
        .groupBy(*by)
        .agg(
            F.sum("incurred").alias("total_incurred"),
            F.sum("ceded").alias("total_ceded"),
            F.sum("claims").alias("claim_count"),
        )
    )
    if source is None:
        return table
    return table.select(F.lit(source).alias("data_source"), *table.columns)


def diagonal_store(
    spark: SparkSession, path: str, keys: Sequence[str] = PRIMARY_KEYS, count_rule: str = "rows"
) -> SnapshotStore:
    """Stored state of a loss run's claims that each new run of ``value_losses`` rows is added to.

    Corrected loss dates are part of the keys, so a run is corrected before it is added.
    """
    return SnapshotStore(spark, path, keys, "evaluation_date", diagonal_measures(count_rule))


def combine_runs(*runs: DataFrame, by: Sequence[str] = ("accident_year", "maturity_bucket")) -> DataFrame:
    """Ceded loss and count over several loss runs; empty cells are dropped."""
    stacked = runs[0]
    for run in runs[1:]:
        stacked = stacked.unionByName(run, allowMissingColumns=True)
    return (
        stacked.groupBy(*by)
        .agg(F.sum("total_ceded").alias("total_ceded"), F.sum("claim_count").alias("claim_count"))
        .filter(F.col("claim_count") > 0)
    )


def clean_trips(df: DataFrame) -> DataFrame:
    """Composite key, trip minutes, and only completed trips of a known segment."""
    renamed = df.withColumn(
        "trip_key", composite_key(*[F.col(f"`{c}`") for c in TRIP_IDS])
    ).drop(*[f"`{c}`" for c in TRIP_IDS])
    kept = renamed.withColumnsRenamed(TRIP_NAMES).filter(
        F.col("trip_distance_mi").isNotNull()
        & (F.col("trip_status") != CANCELED)
        & (F.col("risk_segment") != F.lit(UNKNOWN_SEGMENT))
    )
    return kept.select("trip_key", *TRIP_NAMES.values()).withColumn(
        "trip_minutes", act.minutes_between("start_time", "end_time")
    )


def exposure(trips: DataFrame, by: str | Column = "trip_year") -> DataFrame:
    """Miles (rounded to whole miles), trips and months seen per trip year or column."""
    key = F.year("start_time").alias("trip_year") if by == "trip_year" else as_column(by)
    return trips.groupBy(key).agg(
        round_even(F.sum("trip_distance_mi"), 0).alias("total_miles"),
        F.count(F.lit(1)).alias("n_trips"),
        F.count_distinct(F.month("start_time")).alias("n_exposure_months"),
    )


def loss_cost(
    losses: DataFrame, exposures: DataFrame, valuation_year: int | None = None
) -> DataFrame:
    """Ceded loss cost and claim frequency per mile; null where exposure is missing.

    With a valuation year, ``losses`` is per accident year and the maturity is
    the number of years to that valuation.
    """
    if valuation_year is not None:
        losses = losses.withColumn("maturity", F.lit(valuation_year) - F.col("accident_year"))
    miles = exposures.select("trip_year", "total_miles", "n_exposure_months")
    return join_keyed(losses, miles, {"accident_year": "trip_year"}).withColumns(
        {
            "ceded_loss_cost": round_even(safe_div("total_ceded", "total_miles"), 2),
            "ceded_frequency": safe_div("claim_count", "total_miles"),
        }
    )


def ceded_experience(
    primary: DataFrame,
    excess: DataFrame,
    trips: DataFrame,
    corrections: DataFrame | None = None,
    valuation_year: int | None = None,
) -> DataFrame:
    """Loss cost and frequency of both policies from the raw loss runs and trips."""
    by = ["accident_year"] if valuation_year is not None else ["accident_year", "maturity_bucket"]
    second = clean_excess_names(excess)
    if corrections is not None:
        second = correct_dates(second, corrections)
    runs = [
        latest_diagonal(
            value_losses(primary, *PRIMARY_LAYER), PRIMARY_KEYS, by, "ceded", PRIMARY_SOURCE
        ),
        latest_diagonal(
            value_losses(covered(second), *EXCESS_LAYER, floor_at_zero=False),
            EXCESS_KEYS,
            by,
            "rows",
            EXCESS_SOURCE,
        ),
    ]
    return loss_cost(combine_runs(*runs, by=by), exposure(clean_trips(trips)), valuation_year)


def with_bucket_rank(df: DataFrame) -> DataFrame:
    """Add the ordering rank of the maturity bucket."""
    return df.withColumn("bucket_rank", level_rank("maturity_bucket", act.MATURITY_LEVELS))


def speed_screen(trips: DataFrame, limit: float = 80.0, offset_minutes: float = 0.0) -> DataFrame:
    """Trips with an implausible average speed, in no order.

    Trips of no duration that covered some distance are among them, with a null speed.
    """
    speed = act.average_speed("trip_distance_mi", "trip_minutes", offset_minutes)
    instant = (F.col("trip_minutes") + F.lit(float(offset_minutes)) == 0) & (
        F.col("trip_distance_mi") > 0
    )
    return trips.withColumn("average_mph", speed).filter((F.col("average_mph") > limit) | instant)


def corrections_table(spark, fixes: Mapping[str, dt.date]) -> DataFrame:
    """Corrections from a literal mapping of claim number to loss date."""
    return spark.createDataFrame(
        [(claim, date) for claim, date in fixes.items()], "claim_number string, loss_date date"
    )

