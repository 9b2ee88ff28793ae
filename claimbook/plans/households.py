"""Household features, claim history and the merged modelling tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimbook.functions import actuarial as act
from claimbook.functions.semantics import in_levels, pad_zero, round_even, safe_div
from claimbook.operators.distributions import value_shares
from claimbook.operators.joins import join_fill, join_lookup, require_unique
from claimbook.operators.reshape import pivot_measure, row_count, sum_of

AS_OF = dt.date(2017, 1, 1)

# Bodily injury limits in dollars, prior (0 = none) and current.
PRIOR_LIMITS = (0.0, 25000.0, 50000.0, 100000.0, 250000.0)
CURRENT_LIMITS = (25000.0, 50000.0, 100000.0, 250000.0)

# Columns left out of the model-ready export.
EXPORT_DROPS = (
    "avg_majr_viol",
    "cnt_minr_viol",
    "inforce_ind",
    "prior_insurer_major",
    "prior_insurer_minor",
    "prior_insurer_missing",
)

# Predictors whose own nulls survive the merge of claim counts.
PROTECTED = ("veh_lien_cnt", "prior_bi", "time_w_carr")


def impute_predictors(df: DataFrame) -> DataFrame:
    """Fill the four incomplete predictors.

    Liens are what ownership and lease leave of the total; time with carrier
    and prior limit become 0; credit takes the mean score, rounded. The mean is
    a one-row scalar, not a join.
    """
    mean_credit = df.agg(F.avg("credit_score")).scalar()
    liens = F.col("veh_cnt") - (F.col("veh_own_cnt") + F.col("veh_lease_cnt"))
    return df.withColumns(
        {
            "veh_lien_cnt": F.coalesce("veh_lien_cnt", liens),
            "time_w_carr": F.coalesce("time_w_carr", F.lit(0.0)),
            "prior_bi": F.coalesce("prior_bi", F.lit(0.0)),
            "credit_score": round_even(F.coalesce(F.col("credit_score"), mean_credit), 0),
        }
    )


def bucket_insurer(df: DataFrame, pattern: bool = False, null_to_major: bool = False) -> DataFrame:
    """Insurer bucket and its three 0/1 columns in place of the insurer name."""
    bucket = act.insurer_bucket("curnt_insurer", pattern, null_to_major)
    return (
        df.withColumn("prior_insurer_bucket", bucket)
        .withColumns(
            {
                "prior_insurer_major": (F.col("prior_insurer_bucket") == "Major_Insurer").cast("int"),
                "prior_insurer_minor": (F.col("prior_insurer_bucket") == "Minor_Insurer").cast("int"),
                "prior_insurer_missing": (F.col("prior_insurer_bucket") == "Missing").cast("int"),
            }
        )
        .drop("curnt_insurer")
    )


def clean_predictors(df: DataFrame, drop: Sequence[str] = ("zipcode",)) -> DataFrame:
    """Imputed predictors with limit in dollars, indicator columns and insurer buckets."""
    filled = impute_predictors(df.drop(*drop))
    converted = filled.withColumns(
        {
            "curnt_bi": F.col("curnt_bi_low") * F.lit(1000),
            "hoh_married_ind": F.col("hoh_married").cast("int"),
        }
    ).drop("curnt_bi_low", "curnt_bi_upp", "hoh_married")
    return bucket_insurer(converted)


def _bucket_names(clean: bool) -> dict[str, tuple[str, str]]:
    tidy = {"_f": "at_fault", "_nf": "not_at_fault"}
    slugs = {"< 1 yr": "0_1y", "1-3 yrs": "1_3y", "3-5 yrs": "3_5y", "5+ yrs": "5y_plus"}
    return {
        (f"paid_{slugs[b]}_{tidy[s]}" if clean else f"{b}_{s}"): (b, s)
        for s in ("_f", "_nf")
        for b in act.YEARS_AGO_LEVELS
    }


def paid_history(claims: DataFrame, as_of: dt.date = AS_OF, clean_names: bool = True) -> DataFrame:
    """Paid loss per household by years-ago bucket and fault, wide, zero-filled."""
    labelled = claims.filter(F.col("clm_dates") < F.lit(as_of)).select(
        "hhld_id",
        "pd_amt",
        act.years_ago_bucket("clm_dates", as_of).alias("bucket"),
        act.fault_suffix("aft_ind").alias("fault"),
    )
    return pivot_measure(
        labelled, "hhld_id", ["bucket", "fault"], _bucket_names(clean_names), sum_of("pd_amt"), 0.0
    )


def claim_counts(
    claims: DataFrame, as_of: dt.date = AS_OF, years: int = 5, clean_names: bool = True
) -> DataFrame:
    """Claims per household by accident year and fault over a look-back, zero-filled."""
    start = as_of.replace(year=as_of.year - years)
    recent = claims.filter(
        (F.col("clm_dates") >= F.lit(start)) & (F.col("clm_dates") < F.lit(as_of))
    ).select(
        "hhld_id",
        F.year("clm_dates").alias("year"),
        act.fault_suffix("aft_ind").alias("fault"),
    )
    tidy = {"_f": "at_fault", "_nf": "not_at_fault"}
    last = as_of.year - 1 if (as_of.month, as_of.day) == (1, 1) else as_of.year
    names = {
        (f"claims_{y}_{tidy[s]}" if clean_names else f"{y}_{s}"): (y, s)
        for y in range(start.year, last + 1)
        for s in ("_f", "_nf")
    }
    return pivot_measure(recent, "hhld_id", ["year", "fault"], names, row_count())


def paid_totals(claims: DataFrame, as_of: dt.date = AS_OF, clean_names: bool = True) -> DataFrame:
    """Total paid per household by fault, wide, zero-filled."""
    labelled = claims.filter(F.col("clm_dates") < F.lit(as_of)).select(
        "hhld_id", "pd_amt", act.fault_suffix("aft_ind").alias("fault")
    )
    if clean_names:
        names = {"paid_at_fault": ("_f",), "paid_not_at_fault": ("_nf",)}
    else:
        names = {"Paid_Amt_f": ("_f",), "Paid_Amt_nf": ("_nf",)}
    return pivot_measure(labelled, "hhld_id", ["fault"], names, sum_of("pd_amt"), 0.0)


def claim_history(
    claims: DataFrame, as_of: dt.date = AS_OF, by: str = "bucket", clean_names: bool = True
) -> DataFrame:
    """Claim history per household by ``"bucket"``, ``"year"`` or ``"fault"``."""
    if by == "bucket":
        return paid_history(claims, as_of, clean_names)
    if by == "year":
        return claim_counts(claims, as_of, clean_names=clean_names)
    if by == "fault":
        return paid_totals(claims, as_of, clean_names)
    raise ValueError("by is 'bucket', 'year' or 'fault'")


def household_features(
    predictors: DataFrame, claims: DataFrame, as_of: dt.date = AS_OF, by: str = "bucket"
) -> DataFrame:
    """Clean predictors with their claim history; households without claims get zeros."""
    return join_fill(clean_predictors(predictors), claim_history(claims, as_of, by), "hhld_id")


def merge_experience(
    predictors: DataFrame,
    claims: DataFrame,
    outcomes: DataFrame,
    as_of: dt.date = AS_OF,
    legacy_zero_fill: bool = False,
    check_keys: bool = False,
) -> DataFrame:
    """Predictors, claim counts and outcomes, one row per household with an outcome.

    Only the joined claim counts are zero-filled. ``legacy_zero_fill`` also
    zeroes missing values of every other numeric predictor except the protected
    ones. ``check_keys`` first verifies that outcomes hold one row per household.
    """
    if check_keys:
        outcomes = require_unique(outcomes, "hhld_id")
    merged = join_fill(predictors, claim_counts(claims, as_of), "hhld_id")
    if legacy_zero_fill:
        numeric = [
            name
            for name, kind in predictors.dtypes
            if kind in ("int", "bigint", "double") and name not in (*PROTECTED, "hhld_id")
        ]
        merged = merged.fillna(0, subset=numeric)
    return merged.join(outcomes, "hhld_id", "inner")


def merge_counted(predictors: DataFrame, counts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The merge of ``merge_experience`` over claim counts that are stored with a row per household.

    Where all three tables are kept in equal buckets of ``hhld_id``, no row is moved.
    """
    return join_fill(predictors, counts, "hhld_id").join(outcomes, "hhld_id", "inner")


def modelling_table(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Features left-joined to the response, with the response also as Yes/No."""
    response = outcomes.select("hhld_id", "future_clm_ind")
    joined = features.join(response, "hhld_id", "left").withColumn(
        "future_clm_ind_yn",
        F.when(F.col("future_clm_ind") == 1, "Yes").when(F.col("future_clm_ind").isNotNull(), "No"),
    )
    rest = [c for c in features.columns if c != "hhld_id"]
    return joined.select("hhld_id", "future_clm_ind", "future_clm_ind_yn", *rest)


def collapse_history(
    table: DataFrame, claims: DataFrame, as_of: dt.date = AS_OF, prefix: str = "paid_"
) -> DataFrame:
    """Swap the bucketed claim history for two totals by fault."""
    buckets = [c for c in table.columns if c.startswith(prefix)]
    return join_fill(table.drop(*buckets), paid_totals(claims, as_of), "hhld_id")


def swap_feature(
    table: DataFrame, drop: Sequence[str], source: DataFrame, add: Sequence[str]
) -> DataFrame:
    """Drop features and take others for the same households from another table."""
    return table.drop(*drop).join(source.select("hhld_id", *add), "hhld_id", "inner")


def export_features(features: DataFrame, drop: Sequence[str] = EXPORT_DROPS) -> DataFrame:
    """Model-ready columns: correlated columns and insurer dummies dropped."""
    return features.drop(*drop)


def state_distribution(
    predictors: DataFrame, zip_state: DataFrame
) -> DataFrame:
    """Households per state of their zip code; unmatched zips are listed as NA.

    Households are counted per zip before the lookup, so a crowded zip is one row.
    """
    zips = predictors.groupBy(pad_zero("zipcode", 5).alias("zipcode")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    named = join_lookup(zips, zip_state.select("zipcode", "state"), "zipcode")
    counted = named.groupBy(F.coalesce("state", F.lit("NA")).alias("state")).agg(
        F.sum("_n").alias("n_households")
    )
    total = counted.agg(F.sum("n_households")).scalar()
    return counted.withColumn("share", safe_div(F.col("n_households"), total))


def vehicle_ratios(predictors: DataFrame) -> DataFrame:
    """Vehicles per driver and the type, ownership and coverage shares of vehicles."""
    shares = {
        "perc_auto": "cnt_auto",
        "perc_mtrcyc": "cnt_mtrcyc",
        "perc_own": "veh_own_cnt",
        "perc_lease": "veh_lease_cnt",
        "perc_lien": "veh_lien_cnt",
        "perc_coll": "veh_w_coll_cnt",
        "perc_comp": "veh_w_comp_cnt",
        "perc_ers": "veh_w_ers_cnt",
    }
    return predictors.select(
        "hhld_id",
        safe_div("veh_cnt", "drvr_cnt").alias("veh_per_drvr"),
        *[safe_div(part, "veh_cnt").alias(name) for name, part in shares.items()],
    )


def limit_transition(predictors: DataFrame) -> DataFrame:
    """Share of households per prior and current limit; off-list limits are null."""
    table = predictors.select(
        in_levels(F.col("prior_bi").cast("double"), PRIOR_LIMITS).alias("prior_limit"),
        in_levels((F.col("curnt_bi_low") * 1000).cast("double"), CURRENT_LIMITS).alias(
            "current_limit"
        ),
    )
    return value_shares(table, ["prior_limit", "current_limit"])


def experience_summary(df: DataFrame, flag: str, measures: Mapping[str, str]) -> DataFrame:
    """Count, share, mean and standard deviation of measures per value of a flag.

    ``measures`` maps a label to the column it describes.
    """
    stats = {}
    for label, column in measures.items():
        stats[f"avg_{label}"] = F.avg(column)
        stats[f"sd_{label}"] = F.stddev_samp(column)
    return value_shares(df, [flag], stats)


def portfolio_ratio(df: DataFrame, num: str = "loss_amount", den: str = "premium") -> DataFrame:
    """Totals of two amounts and their ratio, one row."""
    return df.agg(F.sum(num).alias(f"total_{num}"), F.sum(den).alias(f"total_{den}")).withColumn(
        "total_ratio", safe_div(f"total_{num}", f"total_{den}")
    )
