"""Cross-validation, confusion statistics, and reports over logistic models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimbook.functions.semantics import free_name, quoted, safe_div
from claimbook.operators.distributions import histogram
from claimbook.operators.glm import (
    GlmModel,
    build_design,
    complete_rows,
    design_rows,
    fit_rows,
    fit_statistics,
    glm_table,
    importance,
    vif,
)
from claimbook.operators.ranks import hashed_rank

YES, NO = "Yes", "No"


def fold_of(key: Sequence[str], k: int = 10, seed: int = 0) -> Column:
    """Fold number from the MD5 of the key: no shuffle, the same on every run and engine."""
    parts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in key]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % k).cast("int")


def assign_folds(
    df: DataFrame, key: str | Sequence[str], k: int = 10, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Add a fold number; classes are spread evenly in expectation."""
    return df.withColumn(name, fold_of([key] if isinstance(key, str) else key, k, seed))


def stratified_folds(
    df: DataFrame, key: str | Sequence[str], label: str, k: int = 10, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Add a fold number so that each class is spread over the folds as evenly as it can be.

    Rows of a class are dealt round-robin in a seeded random order, so the folds' counts of any
    class differ by one at most. A missing label is a class; no class is ever in one task.
    """
    names = [key] if isinstance(key, str) else list(key)
    rank = free_name("_rank", df.columns)
    ranked = hashed_rank(df, [label], names, seed, rank)
    return ranked.withColumn(name, F.pmod(rank, F.lit(k)).cast("int")).drop(rank)


def with_folds(
    df: DataFrame, key: str, label: str, k: int, seed: int, fold: str | None, stratified: bool
) -> DataFrame:
    """Add ``_fold``: an existing column, or folds dealt by class, or hashed ones."""
    if fold:
        return df.withColumn("_fold", F.col(quoted(fold)))
    if stratified:
        return stratified_folds(df, key, label, k, seed, "_fold")
    return assign_folds(df, key, k, seed, "_fold")


def fold_balance(folded: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """Rows per class and fold, and the class's share of the fold."""
    counts = folded.groupBy(label, fold).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = folded.groupBy(fold).agg(F.count(F.lit(1)).alias("n_fold"))
    return counts.join(sizes, fold).select(
        label, fold, "n_rows", safe_div("n_rows", "n_fold").alias("share")
    )


@dataclass(frozen=True)
class CrossValidated:
    """Out-of-fold predictions and the model fitted on all rows."""

    predictions: DataFrame
    model: GlmModel
    fold_models: dict[int, GlmModel]


def cross_validate(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    categorical: Mapping[str, str | None] | None = None,
    k: int = 10,
    seed: int = 0,
    fold: str | None = None,
    parallelism: int = 4,
    stratified: bool = False,
) -> CrossValidated:
    """k-fold fits with all out-of-fold probabilities, plus one fit on all rows.

    The design is read once and kept for all fits; independent fits run as
    concurrent jobs. The k models are scored in a single pass: each row takes
    the expression of the model that did not see its fold. ``fold`` names an
    existing fold column; without one, folds are hashed, or dealt within each class
    if ``stratified``.
    """
    design = build_design(df, label, features, categorical)
    folded = with_folds(df, key, label, k, seed, fold, stratified)
    rows = design_rows(folded, design, [F.col(quoted(key)).alias("_key"), "_fold"])
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if fold:
            stray = rows.agg(F.count_if(~F.coalesce(F.col("_fold").between(0, k - 1), F.lit(False)))).first()[0]
            if stray:
                raise ValueError(f"{stray} rows have a fold that is missing or not in 0..{k - 1}")
        full = fit_rows(rows, design)
        names = list(design.terms())
        positions = [names.index(t) for t in full.kept]

        @inheritable_thread_target(df.sparkSession)
        def fit_without(i: int) -> tuple[int, GlmModel]:
            return i, fit_rows(rows.filter(F.col("_fold") != i), design, positions)

        with ThreadPool(parallelism) as pool:
            models = dict(pool.map(fit_without, range(k)))
    finally:
        rows.unpersist()

    score = reduce(
        lambda chain, i: chain.when(F.col("_fold") == i, models[i].probability()),
        range(1, k),
        F.when(F.col("_fold") == 0, models[0].probability()),
    )
    predictions = folded.filter(complete_rows(design)).select(
        F.col(quoted(key)).alias(key),
        F.col("_fold").alias("fold"),
        F.when(F.col(quoted(label)) == 1, YES).otherwise(NO).alias("obs"),
        score.alias("probability"),
    )
    return CrossValidated(predictions, full, models)


def decide(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class decision: Yes strictly above the threshold, none without a probability."""
    above = F.col("probability") > threshold
    return df.withColumn("pred", F.when(above, YES).when(F.col("probability").isNotNull(), NO))


def _cells(oof: DataFrame, threshold: float, by: Sequence[str]) -> DataFrame:
    """True/false positives and negatives per group, one aggregate."""
    pred, obs = F.col("pred") == YES, F.col("obs") == YES
    return (
        decide(oof, threshold)
        .groupBy(*by)
        .agg(
            F.count_if(pred & obs).alias("tp"),
            F.count_if(pred & ~obs).alias("fp"),
            F.count_if(~pred & obs).alias("fn"),
            F.count_if(~pred & ~obs).alias("tn"),
        )
    )


def confusion(oof: DataFrame, threshold: float = 0.5, folds: str = "fold") -> DataFrame:
    """Confusion matrix: mean count per fold and share of all rows, four cells."""
    cells = _cells(oof, threshold, [folds])
    sums = cells.agg(
        F.count(F.lit(1)).alias("_k"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    pick = {"tp": (YES, YES), "fp": (YES, NO), "fn": (NO, YES), "tn": (NO, NO)}
    table = F.array(
        *[
            F.struct(
                F.lit(p).alias("pred"),
                F.lit(o).alias("obs"),
                safe_div(c, "_k").alias("avg_count"),
                safe_div(F.col(c), total).alias("share"),
            )
            for c, (p, o) in pick.items()
        ]
    )
    return sums.select(F.explode(table).alias("r")).select("r.*")


def confusion_statistics(
    oof: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, kappa and the rates of the positive class, optionally per group."""
    cells = _cells(oof, threshold, by)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    accuracy = safe_div(tp + tn, n)
    chance = safe_div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sensitivity, specificity = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    return cells.select(
        *by,
        accuracy.alias("accuracy"),
        safe_div(accuracy - chance, 1.0 - chance).alias("kappa"),
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        safe_div(tp, tp + fp).alias("pos_pred_value"),
        safe_div(tn, tn + fn).alias("neg_pred_value"),
        safe_div(tp + fn, n).alias("prevalence"),
        safe_div(tp, n).alias("detection_rate"),
        safe_div(tp + fp, n).alias("detection_prevalence"),
        ((sensitivity + specificity) / F.lit(2.0)).alias("balanced_accuracy"),
    )


def fold_metrics(oof: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy and kappa of every fold."""
    return confusion_statistics(oof, threshold, ["fold"]).select("fold", "accuracy", "kappa")


def probability_histogram(oof: DataFrame, threshold: float = 0.5, bins: int = 30) -> DataFrame:
    """Share of all rows per predicted probability, panel by panel (pred by obs)."""
    return histogram(
        decide(oof, threshold), "probability", bins=bins, by=["pred", "obs"], share="all"
    )


def evaluate_glm(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    categorical: Mapping[str, str | None] | None = None,
    k: int = 10,
    seed: int = 0,
    threshold: float = 0.5,
    stratified: bool = False,
) -> dict[str, DataFrame]:
    """The whole report of one model as named tables."""
    run = cross_validate(df, key, label, features, categorical, k, seed, stratified=stratified)
    spark, oof = df.sparkSession, run.predictions
    return {
        "coefficients": glm_table(spark, run.model),
        "fit": fit_statistics(df, run.model),
        "importance": importance(spark, run.model, scale=True),
        "vif": vif(df, run.model),
        "predictions": oof,
        "confusion": confusion(oof, threshold),
        "statistics": confusion_statistics(oof, threshold),
        "probabilities": probability_histogram(oof, threshold),
        "folds": fold_metrics(oof, threshold),
    }


@dataclass(frozen=True)
class ModelSpec:
    """One model of a comparison."""

    name: str
    table: DataFrame
    features: Sequence[str]
    categorical: Mapping[str, str | None] | None = None


def compare_models(
    specs: Sequence[ModelSpec], key: str, label: str, k: int = 10, seed: int = 0, stratified: bool = False
) -> DataFrame:
    """One row per model: terms, AIC, deviance, accuracy, kappa, largest VIF."""
    rows = []
    for spec in specs:
        run = cross_validate(
            spec.table, key, label, spec.features, spec.categorical, k, seed, stratified=stratified
        )
        facts = fit_statistics(spec.table, run.model).first()
        score = confusion_statistics(run.predictions).first()
        factors = vif(spec.table, run.model).agg(F.max("vif")).first()
        rows.append(
            (
                spec.name,
                int(facts["n_terms"]),
                len(run.model.aliased),
                float(facts["aic"]),
                float(facts["deviance"]),
                score["accuracy"],
                score["kappa"],
                score["balanced_accuracy"],
                None if factors[0] is None else float(factors[0]),
            )
        )
    return specs[0].table.sparkSession.createDataFrame(
        rows,
        "model string, n_terms int, n_aliased int, aic double, deviance double,"
        "accuracy double, kappa double, balanced_accuracy double, max_vif double",
    )
