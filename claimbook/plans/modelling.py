"""The claim-model sequence from the full feature set to the final model."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from claimbook.operators.crossval import ModelSpec, compare_models
from claimbook.operators.lasso import lasso_path, lasso_select
from claimbook.operators.pca import replace_with_scores
from claimbook.plans import households as hh

# Column families that are replaced by component scores, with the
# number of scores kept.
AGE_FAMILY = (
    "min_age",
    "avg_age",
    "max_age",
    "hoh_age",
    "min_mon_lic",
    "avg_mon_lic",
    "max_mon_lic",
    "hoh_mon_lic",
)
DRIVER_FAMILY = (
    "drvr_cnt",
    "cnt_yth",
    "cnt_female",
    "cnt_male",
    "cnt_married",
    "cnt_single",
    "hoh_married_ind",
)
VEHICLE_FAMILY = (
    "veh_cnt",
    "cnt_auto",
    "cnt_mtrcyc",
    "veh_lien_cnt",
    "veh_lease_cnt",
    "veh_own_cnt",
    "veh_w_coll_cnt",
    "veh_w_comp_cnt",
    "veh_w_ers_cnt",
)
FAMILIES = {
    "age_pc": (AGE_FAMILY, 2),
    "demog_pc": (DRIVER_FAMILY, 4),
    "veh_cnt_pc": (VEHICLE_FAMILY, 6),
}

# The final model and the base level of the insurer bucket.
FINAL_FEATURES = ("prior_bi", "credit_score", "avg_age", "inforce_ind")
CATEGORICAL = {"prior_insurer_bucket": "Major_Insurer"}

LABEL = "future_clm_ind"
KEY = "hhld_id"


def features_of(table: DataFrame) -> list[str]:
    """Feature names of a modelling table: all columns but the key and the response."""
    return [c for c in table.columns if c not in (KEY, LABEL, f"{LABEL}_yn")]


def _columns_of(terms: Sequence[str], features: Sequence[str]) -> list[str]:
    """Features behind a list of model terms (a level term names its column)."""
    return [f for f in features if any(t == f or (f in CATEGORICAL and t.startswith(f)) for t in terms)]


def full_table(
    predictors: DataFrame, claims: DataFrame, outcomes: DataFrame, as_of: dt.date
) -> DataFrame:
    """Scored, exported features with bucketed claim history and the response."""
    features = hh.household_features(predictors, claims, as_of)
    scored, _ = replace_with_scores(features, FAMILIES)
    return hh.modelling_table(hh.export_features(scored), outcomes)


def model_sequence(
    predictors: DataFrame,
    claims: DataFrame,
    outcomes: DataFrame,
    as_of: dt.date,
    k: int = 10,
    seed: int = 0,
) -> DataFrame:
    """Compare the nested models, one row each.

    All features; claim history collapsed to two totals; the lasso subset of
    that at one standard error (an empty choice leaves the intercept alone); the
    insurer bucket swapped for the in-force flag; the lasso subset again; average
    age in place of the age score.
    """
    full = full_table(predictors, claims, outcomes, as_of).persist()
    collapsed = hh.collapse_history(full, claims, as_of).persist()
    swapped = hh.swap_feature(
        collapsed, ["prior_insurer_bucket"], predictors, ["inforce_ind"]
    ).persist()
    aged = hh.swap_feature(swapped, [], predictors, ["avg_age"]).persist()
    try:

        def chosen(table: DataFrame, categorical) -> list[str]:
            names = features_of(table)
            path = lasso_path(table, KEY, LABEL, names, categorical, k, seed=seed, stratified=True)
            terms = lasso_select(table, LABEL, names, path.lambda_1se, categorical)
            return _columns_of(terms, names)

        first, second = chosen(collapsed, CATEGORICAL), chosen(swapped, None)
        specs = [
            ModelSpec("all features", full, features_of(full), CATEGORICAL),
            ModelSpec("collapsed history", collapsed, features_of(collapsed), CATEGORICAL),
            ModelSpec(
                "lasso subset",
                collapsed,
                first,
                {c: b for c, b in CATEGORICAL.items() if c in first},
            ),
            ModelSpec("in-force flag", swapped, features_of(swapped)),
            ModelSpec("lasso subset with flag", swapped, second),
            ModelSpec("final", aged, FINAL_FEATURES),
        ]
        return compare_models(specs, KEY, LABEL, k, seed, stratified=True)
    finally:
        for table in (full, collapsed, swapped, aged):
            table.unpersist()
