"""Lasso penalty search by binomial deviance: all folds and a block of penalties per scan.

A proximal Newton step needs each model's gradient and information matrix. One scan sums them
for the training sets of all folds and all penalties of a block at once: every batch becomes
three matrix products, whatever the number of models. The driver solves the penalised quadratic
of each model, whose size is that of the terms. Blocks go from large to small penalties, and
each starts where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimbook.operators.crossval import with_folds
from claimbook.operators.glm import build_design, design_rows
from claimbook.operators.gram import column_means, cross_products
from claimbook.operators.lasso import LassoPath, penalty_choices

_ROWS = 1 << 22  # cells of a block of products


def _sums(n_terms: int, sets: np.ndarray, beta: np.ndarray):
    """Per model: information (upper triangle), gradient, and deviance of training and held-out rows.

    Model ``m`` has the coefficients ``beta[m]`` (intercept first) and leaves out fold ``sets[m]``.
    """
    upper = np.triu_indices(n_terms + 1)

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sets), len(upper[0]) + n_terms + 3))
        step = max(64, _ROWS // len(upper[0]))
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for at in range(0, batch.num_rows, step):
                fold, y, *terms = [c[at : at + step] for c in columns]
                x = np.column_stack([np.ones(len(y)), *terms])
                eta = x @ beta.T
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -35, 35)))
                training = fold[:, None] != sets[None, :]
                loss = 2.0 * (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))) - y[:, None] * eta)
                pairs = x[:, upper[0]] * x[:, upper[1]]
                total[:, : len(upper[0])] += (p * (1 - p) * training).T @ pairs
                total[:, len(upper[0]) : -2] += ((y[:, None] - p) * training).T @ x
                total[:, -2] += (loss * training).sum(0)
                total[:, -1] += (loss * ~training).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sets)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["m", "sums"])

    return reduce_batches


def _scan(rows: DataFrame, n_terms: int, sets: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Information, gradient, training and held-out deviance of every model."""

    def add(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in parts["sums"].to_pylist())
        return pa.table({"m": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "m int, sums binary"
    found = rows.mapInArrow(_sums(n_terms, sets, beta), schema).groupBy("m").applyInArrow(add, schema).toArrow()
    total = np.zeros((len(sets), (n_terms + 1) * (n_terms + 2) // 2 + n_terms + 3))
    for m, blob in zip(found["m"].to_pylist(), found["sums"].to_pylist()):
        total[m] = np.frombuffer(blob, np.float64)
    upper = np.triu_indices(n_terms + 1)
    info = np.zeros((len(sets), n_terms + 1, n_terms + 1))
    info[:, upper[0], upper[1]] = total[:, : len(upper[0])]
    info[:, upper[1], upper[0]] = total[:, : len(upper[0])]
    return info, total[:, len(upper[0]) : -2], total[:, -2], total[:, -1]


def _step(info: np.ndarray, gradient: np.ndarray, beta: np.ndarray, pull: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Minimum of each model's penalised quadratic about ``beta``, by coordinate descent."""
    fresh, slack = beta.copy(), gradient.copy()
    curve = np.maximum(np.einsum("mjj->mj", info), 1e-12)
    for _ in range(2_000):
        largest = 0.0
        for j in range(beta.shape[1]):
            target = slack[:, j] + curve[:, j] * fresh[:, j]
            value = np.sign(target) * np.maximum(np.abs(target) - pull[:, j], 0.0) / curve[:, j]
            value = np.where(np.isfinite(pull[:, j]), value, 0.0)
            move = value - fresh[:, j]
            if move.any():
                slack -= info[:, :, j] * move[:, None]
                fresh[:, j] = value
                largest = max(largest, float(np.abs(move).max()))
        if largest < tol:
            break
    return fresh


def deviance_path(
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
    stratified: bool = False,
    block: int = 25,
    tol: float = 1e-7,
    max_scans: int = 40,
) -> LassoPath:
    """Cross-validated deviance per row over a log-spaced grid of penalties of a logistic lasso.

    Columns are scaled by the population deviation within each training set before the penalty
    applies; the intercept is free. The grid falls from the smallest penalty that empties the
    model of all rows to ``smallest`` times it, in blocks of ``block`` that share their scans
    (``n_scans`` in the result counts all scans of the data). Coefficients are on the columns'
    own scale. A column that is constant in a training set has no slope there.
    """
    design = build_design(df, label, features, categorical)
    terms = list(design.terms())
    if not terms:
        raise ValueError("a penalty search needs a term")
    rows = design_rows(with_folds(df, key, label, k, seed, fold, stratified), design, ["_fold"]).persist()
    try:
        values = [F.col(f"_t{i}") for i in range(len(terms))]
        means = column_means(rows, values)
        centred = [c - F.lit(m) for c, m in zip(values, means)]
        blocks = cross_products(rows, [F.lit(1.0), *centred, F.col("_y")], F.col("_fold"))
        n_scans, total = 2, sum(blocks.values())
        folds = np.array([*blocks, -1])
        moments = np.stack([total - b for b in blocks.values()] + [total])
        n = moments[:, 0, 0]
        shift = moments[:, 0, 1:-1] / n[:, None]
        variance = np.einsum("sjj->sj", moments[:, 1:-1, 1:-1]) / n[:, None] - shift**2
        spread = np.sqrt(np.maximum(variance, 0.0))
        flat = spread <= 1e-12 * (1.0 + np.abs(np.array(means)))
        scale = np.where(flat[-1], 1.0, spread[-1])
        # weight of a slope in the penalty, on the scale of all rows; none for a constant column
        weight = np.where(flat, np.inf, spread / scale)
        rate = moments[:, 0, -1] / n
        pulled = total[1:-1, -1] / n[-1] - total[0, 1:-1] / n[-1] * rate[-1]
        top = float(np.max(np.where(flat[-1], 0.0, np.abs(pulled) / scale)))
        lambdas = top * np.logspace(0.0, np.log10(smallest), n_lambda)

        scaled = rows.select(
            F.col("_fold").cast("int").alias("fold"), "_y",
            *[(c / F.lit(float(s))).alias(f"z{i}") for i, (c, s) in enumerate(zip(centred, scale))])
        n_sets, width = len(folds), len(terms) + 1
        errors, last = np.zeros((n_sets, n_lambda)), np.zeros((n_sets, width))
        final = np.zeros((n_lambda, width))
        last[:, 0] = np.log(rate / (1 - rate))
        for start in range(0, n_lambda, block):
            part = lambdas[start : start + block]
            sets, of = np.tile(np.arange(n_sets), len(part)), np.repeat(np.arange(len(part)), n_sets)
            pull = np.concatenate([np.zeros((len(sets), 1)), part[of][:, None] * weight[sets]], axis=1)
            drag = np.where(np.isfinite(pull), pull, 0.0)
            beta, best = last[sets], np.full(len(sets), np.inf)
            trial, held = beta.copy(), np.zeros(len(sets))
            open_ = np.arange(len(sets))
            while len(open_) and n_scans < max_scans * (1 + start // block + 1):
                info, gradient, training, out = _scan(scaled, len(terms), folds[sets[open_]], trial[open_])
                n_scans += 1
                size = n[sets[open_]]
                value = training / (2 * size) + (drag[open_] * np.abs(trial[open_])).sum(1)
                better = value <= best[open_] + 1e-12
                worse = open_[~better]
                trial[worse] = (trial[worse] + beta[worse]) / 2
                ahead = open_[better]
                beta[ahead], best[ahead], held[ahead] = trial[ahead], value[better], out[better]
                trial[ahead] = _step(
                    info[better] / size[better, None, None], gradient[better] / size[better, None], beta[ahead], pull[ahead])
                moved = np.abs(trial[open_] - beta[open_]).max(1)
                open_ = open_[moved >= tol]
            if len(open_):
                raise ValueError(f"{len(open_)} models have not converged in {n_scans} scans")
            errors[:, start : start + block] = held.reshape(len(part), n_sets).T
            by_set = beta.reshape(len(part), n_sets, width)
            final[start : start + block], last = by_set[:, -1], by_set[-1].copy()
    finally:
        rows.unpersist()
    sizes = np.array([b[0, 0] for b in blocks.values()])
    mean, sd, least, simplest = penalty_choices(lambdas, errors[:-1] / sizes[:, None], sizes)
    return LassoPath(
        tuple(terms), lambdas, mean, sd, (final[:, 1:] != 0).sum(axis=1), final[:, 1:] / scale, least, simplest, n_scans)
