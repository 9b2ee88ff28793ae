"""Logistic regression with full inference, importance and collinearity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted
from claimbook.operators.gram import column_means, cross_products, independent_columns

INTERCEPT = "(Intercept)"
# Log odds at which a fitted probability is 0 or 1 to about 13 digits.
EDGE = 30.0


@dataclass(frozen=True)
class Design:
    """Model terms: numeric columns and one 0/1 term per non-base level."""

    label: str
    features: tuple[str, ...]
    levels: Mapping[str, tuple[str, ...]]

    def terms(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for name in self.features:
            column = F.col(quoted(name))
            if name in self.levels:
                for level in self.levels[name][1:]:
                    out[f"{name}{level}"] = (column == F.lit(level)).cast("double")
            else:
                out[name] = column.cast("double")
        return out


def build_design(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    categorical: Mapping[str, str | None] | None = None,
) -> Design:
    """Terms of a model; each categorical has a base level (first by name if None)."""
    categorical = dict(categorical or {})
    levels: dict[str, tuple[str, ...]] = {}
    for name, base in categorical.items():
        found = df.select(F.col(quoted(name)).alias("v")).filter("v is not null").distinct()
        values = sorted(found.toArrow()["v"].to_pylist())
        first = base if base is not None else values[0]
        if first not in values:
            raise ValueError(f"base level {first!r} does not occur in {name}")
        levels[name] = (first, *[v for v in values if v != first])
    return Design(label, tuple(features), levels)


@dataclass(frozen=True)
class GlmModel:
    """A fitted model: kept and aliased terms and their estimates."""

    design: Design
    kept: tuple[str, ...]
    aliased: tuple[str, ...]
    coefficients: dict[str, float]
    std_errors: dict[str, float]
    z_values: dict[str, float]
    p_values: dict[str, float]
    n_rows: int
    n_iterations: int
    fitted: GeneralizedLinearRegressionModel | None = field(repr=False)
    converged: bool = True

    def linear(self) -> Column:
        """Linear predictor as a plain column expression."""
        terms = self.design.terms()
        parts = [terms[t] * F.lit(self.coefficients[t]) for t in self.kept]
        return reduce(add, parts, F.lit(self.coefficients[INTERCEPT]))

    def probability(self) -> Column:
        """Fitted probability as a plain column expression."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.linear()))


def complete_rows(design: Design) -> Column:
    """True where the label and every term have a usable value."""
    columns = [F.col(quoted(design.label)).cast("double"), *design.terms().values()]
    return reduce(and_, [c.isNotNull() & ~F.isnan(c) for c in columns])


def design_rows(df: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """Label (``_y``) and terms (``_t0`` ...) of the complete rows, plus ``keep``."""
    terms = design.terms()
    return df.filter(complete_rows(design)).select(
        *keep,
        F.col(quoted(design.label)).cast("double").alias("_y"),
        *[t.alias(f"_t{i}") for i, t in enumerate(terms.values())],
    )


def _independent(rows: DataFrame, n_terms: int) -> list[int]:
    """Positions of terms that are not combinations of the intercept and earlier terms."""
    if n_terms == 0:
        return []
    columns = [F.col(f"_t{i}") for i in range(n_terms)]
    means = column_means(rows, columns)
    gram = cross_products(rows, [c - F.lit(m) for c, m in zip(columns, means)]).get(0)
    if gram is None:
        raise ValueError("no complete rows to fit on")
    return independent_columns(gram)


def _intercept_only(rows: DataFrame, design: Design, aliased: tuple[str, ...]) -> GlmModel:
    """A model without terms: the log odds of the rate, in closed form.

    A label of one value only has no finite log odds; they end at ``EDGE``, where the fitted
    probability is that value to all digits, and the model has not converged.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate")).first()
    if not facts["n"]:
        raise ValueError("no complete rows to fit on")
    n, rate = int(facts["n"]), float(facts["rate"])
    inner = 0.0 < rate < 1.0
    estimate = math.log(rate / (1.0 - rate)) if inner else math.copysign(EDGE, rate - 0.5)
    p = 1.0 / (1.0 + math.exp(-abs(estimate)))
    error = 1.0 / math.sqrt(n * p * (1.0 - p))
    z = estimate / error
    return GlmModel(
        design, (), aliased, {INTERCEPT: estimate}, {INTERCEPT: error}, {INTERCEPT: z},
        {INTERCEPT: math.erfc(abs(z) / math.sqrt(2.0))}, n, 0, None, inner,
    )


def fit_rows(
    rows: DataFrame,
    design: Design,
    kept: Sequence[int] | None = None,
    max_iter: int = 25,
    tol: float = 1e-8,
) -> GlmModel:
    """Fit on the output of ``design_rows``; aliased terms are found and left out."""
    names = list(design.terms())
    positions = list(kept) if kept is not None else _independent(rows, len(names))
    if not positions:
        return _intercept_only(rows, design, tuple(names))
    assembled = VectorAssembler(
        inputCols=[f"_t{i}" for i in positions], outputCol="features"
    ).transform(rows)
    fitted = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="_y", maxIter=max_iter, tol=tol
    ).fit(assembled.select("features", "_y"))
    summary = fitted.summary
    ordered = [names[i] for i in positions] + [INTERCEPT]

    def named(values) -> dict[str, float]:
        return dict(zip(ordered, (float(v) for v in values)))

    return GlmModel(
        design,
        tuple(names[i] for i in positions),
        tuple(n for i, n in enumerate(names) if i not in positions),
        named([*fitted.coefficients, fitted.intercept]),
        named(summary.coefficientStandardErrors),
        named(summary.tValues),
        named(summary.pValues),
        int(summary.numInstances),
        int(summary.numIterations),
        fitted,
        int(summary.numIterations) < max_iter,
    )


def fit_glm(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    categorical: Mapping[str, str | None] | None = None,
    max_iter: int = 25,
    tol: float = 1e-8,
) -> GlmModel:
    """Logistic model of a 0/1 label; rows with a missing value are left out.

    Terms that are exact combinations of earlier ones are dropped first and
    listed in ``aliased``; the fit itself is distributed iteratively reweighted
    least squares.
    """
    design = build_design(df, label, features, categorical)
    rows = design_rows(df, design).persist()
    try:
        return fit_rows(rows, design, None, max_iter, tol)
    finally:
        rows.unpersist()


def glm_table(spark: SparkSession, model: GlmModel) -> DataFrame:
    """Estimate, standard error, z and p per term; aliased terms have nulls."""
    rows = [
        (t, model.coefficients[t], model.std_errors[t], model.z_values[t], model.p_values[t])
        for t in (INTERCEPT, *model.kept)
    ] + [(t, None, None, None, None) for t in model.aliased]
    return spark.createDataFrame(
        rows, "term string, estimate double, std_error double, z_value double, p_value double"
    )


def fit_statistics(df: DataFrame, model: GlmModel) -> DataFrame:
    """Rows, deviance, null deviance, AIC and convergence of a model, one scan.

    For a 0/1 label the deviance is minus twice the log likelihood.
    """
    label = F.col(quoted(model.design.label)).cast("double")
    p = model.probability()
    eta = model.linear()
    # log(1 + exp(eta)) written so that large predictors do not overflow
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    facts = (
        df.filter(complete_rows(model.design))
        .select(label.alias("y"), (label * eta - softplus).alias("ll"), p.alias("p"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("ll").alias("ll"),
            F.avg("y").alias("rate"),
            F.count_if((F.col("p") < 1e-10) | (F.col("p") > 1 - 1e-10)).alias("n_extreme"),
        )
    )
    n_terms = len(model.kept) + 1
    rate = F.col("rate")
    null_ll = F.col("n_rows") * (
        F.when(rate > 0, rate * F.ln(rate)).otherwise(0.0)
        + F.when(rate < 1, (1 - rate) * F.ln(1 - rate)).otherwise(0.0)
    )
    return facts.select(
        "n_rows",
        F.lit(n_terms).alias("n_terms"),
        (-2.0 * F.col("ll")).alias("deviance"),
        (-2.0 * null_ll).alias("null_deviance"),
        (-2.0 * F.col("ll") + 2.0 * n_terms).alias("aic"),
        F.lit(model.n_iterations).alias("n_iterations"),
        "n_extreme",
    )


def importance(spark: SparkSession, model: GlmModel, scale: bool = False) -> DataFrame:
    """Absolute z value per term, optionally scaled to 0-100, largest first."""
    values = {t: abs(model.z_values[t]) for t in model.kept}
    if scale and values:
        low, high = min(values.values()), max(values.values())
        width = (high - low) or 1.0
        values = {t: 100.0 * (v - low) / width for t, v in values.items()}
    rows = sorted(values.items(), key=lambda item: (-item[1], item[0]))
    return spark.createDataFrame(rows, "term string, importance double")


def inflation_factors(information: np.ndarray) -> np.ndarray:
    """Variance inflation per slope from the information matrix (intercept first)."""
    covariance = np.linalg.inv(information)[1:, 1:]
    return np.diag(covariance) * np.diag(np.linalg.inv(covariance))


def vif(
    df: DataFrame, model: GlmModel, weighted: bool = True, threshold: float = 5.0
) -> DataFrame:
    """Variance inflation factor per term, largest first, flagged at the threshold.

    One scan sums the cross products, weighted by p(1 - p) of the fitted model
    (or unweighted); the matrix is terms by terms.
    """
    if not model.kept:
        return df.sparkSession.createDataFrame([], "term string, vif double, is_high boolean")
    terms = model.design.terms()
    p = model.probability()
    weight = p * (F.lit(1.0) - p) if weighted else None
    columns = [F.lit(1.0), *[terms[t] for t in model.kept]]
    information = cross_products(
        df.filter(complete_rows(model.design)), columns, weight=weight
    )[0]
    factors = inflation_factors(information)
    rows = sorted(
        ((t, float(f), bool(f > threshold)) for t, f in zip(model.kept, factors)),
        key=lambda r: (-r[1], r[0]),
    )
    return df.sparkSession.createDataFrame(rows, "term string, vif double, is_high boolean")
