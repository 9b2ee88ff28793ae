"""Imputation and components refitted inside each fold, so no held-out row is in a fitted number.

One scan sums the products of values and of their masks per fold. The training set of a fold
is the total less the fold: its means fill missing values, and its correlations give the
components, one small eigen decomposition per fold on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted
from claimbook.operators.crossval import NO, YES, with_folds
from claimbook.operators.glm import Design, GlmModel, build_design, complete_rows, fit_rows
from claimbook.operators.gram import column_means, cross_products
from claimbook.operators.pca import PcaModel
from claimbook.sources.scratch import materialize

Families = Mapping[str, tuple[Sequence[str], int]]


@dataclass(frozen=True)
class FoldComponents:
    """Components per fold and family, each fitted without that fold's rows."""

    models: dict[int, dict[str, PcaModel]]

    def _score(self, model: PcaModel, j: int) -> Column:
        parts = [
            F.coalesce(_present(c) - F.lit(float(m)), F.lit(0.0)) * F.lit(float(w / s))
            for c, m, s, w in zip(model.columns, model.mean, model.scale, model.loadings[:, j])]
        return reduce(lambda a, b: a + b, parts)

    def scores(self, i: int) -> dict[str, Column]:
        """Scores of any row by the components that fold ``i`` had no part in."""
        return {n: self._score(m, j) for m in self.models[i].values() for j, n in enumerate(m.names())}

    def scored(self, df: DataFrame, i: int) -> DataFrame:
        """The rows with the families replaced by their scores for fold ``i``."""
        used = {c for m in self.models[i].values() for c in m.columns}
        return df.withColumns(self.scores(i)).drop(*used)

    def held_out(self, df: DataFrame, fold: str) -> DataFrame:
        """Every row scored by the components of its own fold, in one pass."""
        by_fold = {i: self.scores(i) for i in self.models}
        names = list(next(iter(by_fold.values())))
        chosen = {
            n: reduce(lambda chain, i: chain.when(F.col(fold) == i, by_fold[i][n]), list(by_fold)[1:],
                      F.when(F.col(fold) == next(iter(by_fold)), next(iter(by_fold.values()))[n]))
            for n in names}
        return df.withColumns(chosen)


def _present(c: str) -> Column:
    """The value as a number, null if it is missing or not a number."""
    v = F.col(quoted(c)).cast("double")
    return F.when(~F.isnan(v), v)


def fold_components(df: DataFrame, families: Families, fold: str) -> FoldComponents:
    """Components of column families for every fold of the integer column ``fold``.

    Missing values take the mean of the training rows that have one. Columns are centred and
    scaled (n - 1) on the training rows; the sign of a component makes its largest loading
    positive. A column that is constant in a training set is refused by name.
    """
    columns = list(dict.fromkeys(c for cols, _ in families.values() for c in cols))
    p = len(columns)
    values = [_present(c) for c in columns]
    # about the means of all rows, which cancel out below, so that large means lose no digits
    origin = column_means(df, values)
    masks = [v.isNotNull().cast("double") for v in values]
    filled = [F.coalesce(v - F.lit(o), F.lit(0.0)) for v, o in zip(values, origin)]
    blocks = cross_products(df, [F.lit(1.0), *masks, *filled], F.col(quoted(fold)))
    total = sum(blocks.values())
    models: dict[int, dict[str, PcaModel]] = {}
    for i, block in blocks.items():
        s = total - block
        n, both, one, two = s[0, 0], s[1 : p + 1, 1 : p + 1], s[p + 1 :, 1 : p + 1], s[p + 1 :, p + 1 :]
        if n < 2:
            raise ValueError("components need two training rows for every fold")
        mean = np.divide(np.diag(one), np.diag(both), out=np.zeros(p), where=np.diag(both) > 0)
        products = two - one * mean[None, :] - one.T * mean[:, None] + np.outer(mean, mean) * both
        spread = np.sqrt(np.maximum(np.diag(products), 0.0) / (n - 1))
        models[i] = {}
        for prefix, (cols, k) in families.items():
            at = [columns.index(c) for c in cols]
            flat = [c for c, j in zip(cols, at) if spread[j] <= 1e-12 * (1.0 + abs(origin[j]))]
            if flat:
                raise ValueError(f"constant columns have no components: {flat}")
            r = products[np.ix_(at, at)] / (n - 1) / np.outer(spread[at], spread[at])
            size, loadings = np.linalg.eigh(r)
            size, loadings = size[::-1], loadings[:, ::-1]
            largest = np.argmax(np.round(np.abs(loadings), 9), axis=0)
            loadings = loadings * np.sign(loadings[largest, np.arange(len(at))])
            models[i][prefix] = PcaModel(
                tuple(cols), mean[at] + np.array(origin)[at], spread[at], loadings, size / size.sum(), prefix, k)
    return FoldComponents(models)


@dataclass(frozen=True)
class FoldwiseRun:
    """Out-of-fold predictions, and the model and components of every fold."""

    predictions: DataFrame
    fold_models: dict[int, GlmModel]
    components: FoldComponents


def cross_validate_components(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    families: Families,
    categorical: Mapping[str, str | None] | None = None,
    k: int = 10,
    seed: int = 0,
    fold: str | None = None,
    stratified: bool = True,
    parallelism: int = 4,
) -> FoldwiseRun:
    """k-fold predictions of a logistic model over other features and components of each fold's own.

    For every fold the components (and the means for their missing values) come from the other
    folds, the model is fitted on those folds' scores, and the fold itself is scored by both.
    Rows that miss a feature outside the families are left out.
    """
    used = list(dict.fromkeys(c for cols, _ in families.values() for c in cols))
    plain = build_design(df, label, features, categorical)
    wanted = [key, label, *features, *used, *([fold] if fold else [])]
    rows = df.filter(complete_rows(plain)).select(*[quoted(c) for c in dict.fromkeys(wanted)])
    # written once: all fits and the predictions read it, and their plans stay short
    folded = materialize(with_folds(rows, key, label, k, seed, fold, stratified))
    found = fold_components(folded, families, "_fold")
    names = [*features, *found.scores(next(iter(found.models)))]
    design = Design(label, tuple(names), plain.levels)

    @inheritable_thread_target(df.sparkSession)
    def fit_without(i: int) -> tuple[int, GlmModel]:
        # rows that miss a feature are gone, and a score is never missing
        ready = found.scored(folded.filter(F.col("_fold") != i), i).select(
            F.col(quoted(label)).cast("double").alias("_y"), *[t.alias(f"_t{j}") for j, t in enumerate(design.terms().values())]
        ).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return i, fit_rows(ready, design)
        finally:
            ready.unpersist()

    with ThreadPool(parallelism) as pool:
        models = dict(pool.map(fit_without, list(found.models)))

    def predicted(i: int) -> DataFrame:
        held = found.scored(folded.filter(F.col("_fold") == i), i)
        return held.select(
            F.col(quoted(key)).alias(key), F.col("_fold").alias("fold"),
            F.when(F.col(quoted(label)) == 1, YES).otherwise(NO).alias("obs"), models[i].probability().alias("probability"))

    return FoldwiseRun(reduce(DataFrame.unionAll, [predicted(i) for i in models]), models, found)
