"""Principal components of standardised columns, scores kept with their row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted


@dataclass(frozen=True)
class PcaModel:
    """Centre, scale, loadings (columns by components) and variance shares."""

    columns: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    shares: np.ndarray
    prefix: str
    k: int

    def names(self) -> list[str]:
        return [f"{self.prefix}{i + 1}" for i in range(self.k)]


def fit_pca(df: DataFrame, cols: Sequence[str], k: int, prefix: str = "pc") -> PcaModel:
    """Centre and scale (n - 1) the columns and find their components.

    All p components are found, the first ``k`` are kept for scores. The sign
    of a component is fixed by making its largest loading positive. Rows with a
    missing value are left out; constant columns are refused by name.
    """
    rows = df.select(*[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    assembler = VectorAssembler(inputCols=rows.columns, outputCol="raw", handleInvalid="skip")
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    components = PCA(k=len(cols), inputCol="scaled", outputCol="scores")
    fitted = Pipeline(stages=[assembler, scaler, components]).fit(rows)
    scale = fitted.stages[1].std.toArray()
    constant = [c for c, s in zip(cols, scale) if s == 0]
    if constant:
        raise ValueError(f"constant columns have no components: {constant}")
    loadings = fitted.stages[2].pc.toArray()
    largest = np.argmax(np.round(np.abs(loadings), 9), axis=0)
    signs = np.sign(loadings[largest, np.arange(loadings.shape[1])])
    return PcaModel(
        tuple(cols),
        fitted.stages[1].mean.toArray(),
        scale,
        loadings * signs,
        fitted.stages[2].explainedVariance.toArray(),
        prefix,
        k,
    )


def pca_variance(spark: SparkSession, model: PcaModel) -> DataFrame:
    """Share of variance per component and its running total."""
    running = np.cumsum(model.shares)
    rows = [
        (i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(model.shares, running))
    ]
    return spark.createDataFrame(rows, "component int, share double, cumulative double")


def pca_loadings(spark: SparkSession, model: PcaModel) -> DataFrame:
    """Loading of every column on every component, long."""
    rows = [
        (name, j + 1, float(model.loadings[i, j]))
        for i, name in enumerate(model.columns)
        for j in range(model.loadings.shape[1])
    ]
    return spark.createDataFrame(rows, "name string, component int, loading double")


def pca_scores(model: PcaModel, df: DataFrame) -> DataFrame:
    """Add the first k scores as columns of the same row (plain expressions)."""
    scores = {}
    for j, name in enumerate(model.names()):
        terms = [
            (F.col(quoted(c)).cast("double") - float(m)) * float(w / s)
            for c, m, s, w in zip(model.columns, model.mean, model.scale, model.loadings[:, j])
        ]
        scores[name] = reduce(add, terms)
    return df.withColumns(scores)


def replace_with_scores(
    df: DataFrame, families: Mapping[str, tuple[Sequence[str], int]]
) -> tuple[DataFrame, dict[str, PcaModel]]:
    """Swap column families for their scores.

    ``families`` maps a score prefix to the columns and the number of scores.
    """
    models = {p: fit_pca(df, cols, k, p) for p, (cols, k) in families.items()}
    scored = df
    for model in models.values():
        scored = pca_scores(model, scored)
    used = [c for cols, _ in families.values() for c in cols]
    return scored.drop(*used), models
