"""Lasso penalty search from one pass over the data, and L1 feature selection.

A squared-error lasso needs nothing but sums of products. One scan gathers them
per fold; every training set is then the total less one fold, and held-out
errors follow from the fold's own sums. The driver only sees matrices of the
size of the model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimbook.operators.crossval import with_folds
from claimbook.operators.glm import build_design, design_rows
from claimbook.operators.gram import column_means, cross_products


@dataclass(frozen=True)
class LassoPath:
    """Cross-validated error per penalty and the two usual choices."""

    terms: tuple[str, ...]
    lambdas: np.ndarray
    errors: np.ndarray
    error_sds: np.ndarray
    n_nonzero: np.ndarray
    coefficients: np.ndarray
    lambda_min: float
    lambda_1se: float
    n_scans: int = 2

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (float(a), float(b), float(c), int(d))
            for a, b, c, d in zip(self.lambdas, self.errors, self.error_sds, self.n_nonzero)
        ]
        return spark.createDataFrame(
            rows, "lambda double, cv_error double, cv_sd double, n_nonzero int"
        )


@dataclass(frozen=True)
class _Moments:
    """Sums of products split into rows, means, and centred blocks per row."""

    n: float
    x_mean: np.ndarray
    y_mean: float
    x_scale: np.ndarray
    gram: np.ndarray
    target: np.ndarray


def _moments(sums: np.ndarray) -> _Moments:
    """From the sums of products of (1, x..., y): standardised blocks (n divisor)."""
    n = sums[0, 0]
    means = sums[0, 1:] / n
    centred = sums[1:, 1:] / n - np.outer(means, means)
    spread = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0))
    flat = spread <= 1e-12 * (1.0 + np.abs(means[:-1]))
    scale = np.where(flat, np.inf, spread)
    return _Moments(
        n,
        means[:-1],
        float(means[-1]),
        scale,
        centred[:-1, :-1] / np.outer(scale, scale),
        centred[:-1, -1] / scale,
    )


def _descend(
    moments: Sequence[_Moments], lambdas: np.ndarray, tol: float, max_sweeps: int
) -> np.ndarray:
    """Standardised coefficients per training set and falling penalty, warm-started.

    All training sets take a step together. After each sweep over all
    coordinates those in use are settled before the next.
    """
    gram = np.stack([m.gram for m in moments])
    slack = np.stack([m.target for m in moments])
    active = np.stack([np.isfinite(m.x_scale) for m in moments])
    sets, p = slack.shape
    beta, out = np.zeros((sets, p)), np.zeros((sets, len(lambdas), p))

    def sweep(columns, lam: float) -> float:
        nonlocal slack
        largest = 0.0
        for j in columns:
            pull = slack[:, j] + beta[:, j]
            fresh = np.where(active[:, j], np.sign(pull) * np.maximum(np.abs(pull) - lam, 0.0), 0.0)
            move = fresh - beta[:, j]
            if move.any():
                slack -= gram[:, :, j] * move[:, None]
                beta[:, j] = fresh
                largest = max(largest, float(np.abs(move).max()))
        return largest

    for step, lam in enumerate(lambdas):
        for _ in range(max_sweeps):
            if sweep(range(p), lam) < tol:
                break
            for _ in range(max_sweeps):
                if sweep(np.flatnonzero(beta.any(axis=0)), lam) < tol:
                    break
        out[:, step] = beta
    return out


def penalty_choices(
    lambdas: np.ndarray, errors: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and standard error over the folds, the best penalty, and the largest one within a
    standard error of it; ``errors`` is folds by penalties."""
    mean = np.average(errors, axis=0, weights=sizes)
    variance = np.average((errors - mean) ** 2, axis=0, weights=sizes)
    sd = np.sqrt(variance / (len(sizes) - 1))
    best = int(np.argmin(mean))
    within = np.flatnonzero(mean <= mean[best] + sd[best])[0]
    return mean, sd, float(lambdas[best]), float(lambdas[within])


def _held_out_error(sums: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """Mean squared error of a linear model on the rows behind ``sums``."""
    c = np.concatenate([[-intercept], -beta, [1.0]])
    return float(c @ sums @ c) / sums[0, 0]


def lasso_path(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    categorical: Mapping[str, str | None] | None = None,
    k: int = 10,
    n_lambda: int = 100,
    smallest: float = 1e-4,
    seed: int = 0,
    fold: str | None = None,
    tol: float = 1e-8,
    max_sweeps: int = 10_000,
    stratified: bool = False,
) -> LassoPath:
    """Squared-error cross-validation over a log-spaced penalty grid.

    The grid falls from the smallest penalty that empties the model to
    ``smallest`` times it. ``lambda_1se`` is the largest penalty whose error is
    within one standard error of the best.
    """
    design = build_design(df, label, features, categorical)
    rows = design_rows(with_folds(df, key, label, k, seed, fold, stratified), design, ["_fold"])
    terms = list(design.terms())
    values = [*[F.col(f"_t{i}") for i in range(len(terms))], F.col("_y")]
    # Sums of products about the means of all rows; penalties, errors and slopes do not change.
    means = column_means(rows, values)
    columns = [F.lit(1.0), *[c - F.lit(m) for c, m in zip(values, means)]]
    blocks = cross_products(rows, columns, F.col("_fold"))
    total = sum(blocks.values())

    everything = _moments(total)
    top = float(np.max(np.abs(everything.target)))
    lambdas = top * np.logspace(0.0, np.log10(smallest), n_lambda)
    held_out = list(blocks.values())
    training = [_moments(total - block) for block in held_out]
    paths = _descend([*training, everything], lambdas, tol, max_sweeps)
    errors, sizes = [], []
    for block, m, path in zip(held_out, training, paths):
        betas = path / m.x_scale
        intercepts = m.y_mean - betas @ m.x_mean
        errors.append([_held_out_error(block, a, b) for a, b in zip(intercepts, betas)])
        sizes.append(block[0, 0])
    mean, sd, least, simplest = penalty_choices(lambdas, np.array(errors), np.array(sizes))
    final = paths[-1]
    return LassoPath(
        tuple(terms),
        lambdas,
        mean,
        sd,
        (final != 0).sum(axis=1),
        final / everything.x_scale,
        least,
        simplest,
    )


def lasso_coefficients(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    lam: float,
    categorical: Mapping[str, str | None] | None = None,
    max_iter: int = 500,
    tol: float = 1e-10,
) -> dict[str, float]:
    """Coefficients of an L1-penalised logistic model at one penalty.

    Columns are scaled by their population standard deviation before the
    penalty applies, and reported on their own scale.
    """
    design = build_design(df, label, features, categorical)
    rows = design_rows(df, design).persist()
    try:
        terms = list(design.terms())
        facts = rows.agg(*[F.stddev_pop(f"_t{i}").alias(f"s{i}") for i in range(len(terms))]).first()
        spread = [facts[f"s{i}"] for i in range(len(terms))]
        used = [i for i, s in enumerate(spread) if s]
        scaled = rows.select(
            "_y", *[(F.col(f"_t{i}") / F.lit(spread[i])).alias(f"_z{i}") for i in used]
        )
        vectors = VectorAssembler(
            inputCols=[f"_z{i}" for i in used], outputCol="features"
        ).transform(scaled)
        model = LogisticRegression(
            labelCol="_y",
            elasticNetParam=1.0,
            regParam=lam,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        ).fit(vectors.select("features", "_y"))
    finally:
        rows.unpersist()
    out = {t: 0.0 for t in terms}
    for i, value in zip(used, model.coefficients):
        out[terms[i]] = float(value) / spread[i]
    return out


def lasso_select(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    lam: float,
    categorical: Mapping[str, str | None] | None = None,
) -> list[str]:
    """Names of the terms a penalised logistic model keeps."""
    values = lasso_coefficients(df, label, features, lam, categorical)
    return [t for t, v in values.items() if v != 0.0]
