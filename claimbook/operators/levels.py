"""Categories with any number of levels: numbered level tables and a logistic fit that never lists the levels.

A category of 100,000 zip codes is 100,000 terms of a design, and a matrix of that many squared.
Here levels stay rows of a table on the executors. One Newton step is one map-side combined
aggregate by level: the block of the information that belongs to the levels is diagonal, so it is
eliminated level by level, and only a matrix of the few numeric terms reaches the driver. Estimates
and standard errors are those of the full design.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from claimbook.functions.semantics import quoted
from claimbook.operators.gram import independent_columns
from claimbook.operators.joins import join_group_values
from claimbook.sources.scratch import remove, shared_folder

# Share of its information that a term keeps at least when the levels do not determine it.
DETERMINED = 1e-10


def index_levels(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``level, position, n`` of every value of a column; positions from 0 in the order of the values.

    The distinct values are dealt to ranges and numbered inside their range; offsets come from one
    count per range. No list of levels leaves the executors. Missing values are no level. The
    counted values are kept in ``path`` (default: a fresh shared folder).
    """
    spark = df.sparkSession
    path = path or shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = df.select(F.col(quoted(name)).alias("level")).filter("level is not null").groupBy("level").agg(
        F.count(F.lit(1)).alias("n"))
    # written once, so that a rerun task cannot move a value to another range
    counted.repartitionByRange(parts, "level").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_m"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy("level")
    return placed.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, "_range").select(
        "level", (F.col("_offset") + F.col("_place")).alias("position"), "n")


@dataclass(frozen=True)
class LevelModel:
    """A logistic model with one category of many levels and a few numeric terms.

    ``effects`` is a stored table: ``level, position, n, n_yes, effect, weight, separated`` and the
    products ``_b0`` ... of each level's information with the numeric terms.
    """

    label: str
    category: str
    kept: tuple[str, ...]
    aliased: tuple[str, ...]
    estimates: dict[str, float]
    covariance: np.ndarray
    centres: dict[str, float]
    effects: DataFrame
    path: str
    log_likelihood: float
    n_rows: int
    n_iterations: int
    converged: bool


def _x(i: int) -> Column:
    return F.col(f"_x{i}")


def _statistics(rows: DataFrame, effects: DataFrame, beta: Sequence[float], share: float) -> DataFrame:
    """Per level: gradient, information and log likelihood at ``effect + share * step``."""
    p = len(beta)
    at = effects.select("position", "n", (F.col("effect") + F.lit(share) * F.col("step")).alias("_effect"))
    joined = join_group_values(rows, at, ["position"], "n").filter("_effect is not null")
    eta = F.col("_effect")
    for i, b in enumerate(beta):
        eta = eta + _x(i) * F.lit(float(b))
    staged = joined.withColumn("_eta", eta).withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_eta"))))
    softplus = F.greatest(F.col("_eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta")))
    staged = staged.select(
        "position", *[f"_x{i}" for i in range(p)], (F.col("_y") - F.col("_p")).alias("_r"),
        (F.col("_p") * (1.0 - F.col("_p"))).alias("_w"), (F.col("_y") * F.col("_eta") - softplus).alias("_ll"))
    return staged.groupBy("position").agg(
        F.sum("_ll").alias("ll"), F.sum("_r").alias("g"), F.sum("_w").alias("weight"), F.max(F.lit(share)).alias("_at"),
        *[F.sum(_x(i) * F.col("_w")).alias(f"_b{i}") for i in range(p)],
        *[F.sum(_x(i) * F.col("_r")).alias(f"_g{i}") for i in range(p)],
        *[F.sum(_x(i) * _x(j) * F.col("_w")).alias(f"_a{i}_{j}") for i in range(p) for j in range(i, p)],
    )


def _reduced(stats: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, and gradient and information of the numeric terms with the levels eliminated.

    A term that the levels determine leaves rounding of its own information; that becomes 0.
    """
    facts = stats.agg(
        F.sum("ll").alias("ll"),
        *[F.sum(F.col(f"_g{i}") - F.col(f"_b{i}") * F.col("g") / F.col("weight")).alias(f"g{i}") for i in range(p)],
        *[F.sum(F.col(f"_a{i}_{j}") - F.col(f"_b{i}") * F.col(f"_b{j}") / F.col("weight")).alias(f"a{i}_{j}")
          for i in range(p) for j in range(i, p)],
        *[F.sum(f"_a{i}_{i}").alias(f"t{i}") for i in range(p)],
    ).first()
    gradient = np.array([facts[f"g{i}"] or 0.0 for i in range(p)])
    matrix = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            matrix[i, j] = matrix[j, i] = facts[f"a{i}_{j}"] or 0.0
    spent = np.array([matrix[i, i] <= DETERMINED * (facts[f"t{i}"] or 0.0) for i in range(p)], bool)
    matrix[spent, :] = matrix[:, spent] = 0.0
    return float(facts["ll"] or 0.0), gradient, matrix


def fit_levels(
    df: DataFrame, label: str, category: str, features: Sequence[str] = (), max_iter: int = 50, tol: float = 1e-10
) -> LevelModel:
    """Logistic model of a 0/1 label on a category of any size and numeric features.

    Rows with a missing value are left out. A level whose labels are all equal has an infinite
    effect and says nothing about the other terms; it is marked ``separated`` and takes no part in
    the steps, which is the limit of the full fit. Numeric terms that are combinations of the
    levels and of earlier terms are aliased. The rows of one level may be any share of all.
    """
    spark = df.sparkSession
    numbers = [F.col(quoted(c)).cast("double") for c in (label, *features)]
    usable = F.col(quoted(category)).isNotNull()
    for c in numbers:
        usable = usable & c.isNotNull() & ~F.isnan(c)
    complete = df.filter(usable).select(
        F.col(quoted(category)).alias("level"), numbers[0].alias("_y"),
        *[c.alias(f"_x{i}") for i, c in enumerate(numbers[1:])])
    paths = [shared_folder(spark)]
    index = index_levels(complete, "level", paths[0])
    facts = complete.agg(F.count(F.lit(1)).alias("n"), *[F.avg(_x(i)).alias(f"m{i}") for i in range(len(features))]).first()
    if not facts["n"]:
        remove(spark, paths[0])
        raise ValueError("no complete rows to fit on")
    centre = [facts[f"m{i}"] for i in range(len(features))]
    rows = join_group_values(complete, index, ["level"], "n").select(
        "position", "_y", *[(_x(i) - F.lit(m)).alias(f"_x{i}") for i, m in enumerate(centre)]
    ).persist(StorageLevel.MEMORY_AND_DISK)
    cached = rows

    def stored(table: DataFrame) -> DataFrame:
        paths.append(shared_folder(spark))
        table.write.parquet(paths[-1])
        return spark.read.schema(table.schema).parquet(paths[-1])

    try:
        yes = rows.groupBy("position").agg(F.sum("_y").alias("n_yes"))
        odds = F.ln(F.col("n_yes") / (F.col("n") - F.col("n_yes")))
        alike = (F.col("n_yes") == 0) | (F.col("n_yes") == F.col("n"))
        everything = stored(index.join(yes, "position").withColumn("separated", alike))
        effects = everything.filter(~F.col("separated")).select(
            "position", "n", odds.alias("effect"), F.lit(0.0).alias("step"))
        used = list(range(len(features)))
        beta, move, share = np.zeros(len(used)), np.zeros(len(used)), 1.0
        last, converged, rounds = -math.inf, False, 0
        while True:
            rounds += 1
            stats = stored(_statistics(rows, effects, beta + share * move, share))
            ll, gradient, matrix = _reduced(stats, len(used))
            if rounds == 1:
                kept = independent_columns(matrix)
                if kept != used:
                    aside = rows.select("position", "_y", *[_x(i).alias(f"_x{k}") for k, i in enumerate(kept)])
                    rows, used = aside, kept
                    beta, move = np.zeros(len(used)), np.zeros(len(used))
                    stats = stored(_statistics(rows, effects, beta, share))
                    ll, gradient, matrix = _reduced(stats, len(used))
            elif ll < last - 1e-9 * (abs(last) + 1.0) and share > 1e-6:
                share /= 2.0  # the step went too far
                continue
            beta = beta + share * move
            move = np.linalg.solve(matrix, gradient) if len(used) else np.zeros(0)
            change = F.col("g") / F.col("weight")
            for i, m in enumerate(move):
                change = change - F.col(f"_b{i}") / F.col("weight") * F.lit(float(m))
            effects = stored(effects.join(stats, "position").select(
                "position", "n", (F.col("effect") + F.col("_at") * F.col("step")).alias("effect"), change.alias("step")))
            converged = abs(ll - last) <= tol * (abs(ll) + 1.0)
            last, share = ll, 1.0
            if converged or rounds >= max_iter:
                break
        found = effects.drop("step", "n").join(stats.select("position", "weight", *[f"_b{i}" for i in range(len(used))]), "position")
        path = shared_folder(spark)
        everything.join(found, "position", "left").write.parquet(path)
        kept_names = tuple(features[i] for i in used)
        return LevelModel(
            label, category, kept_names, tuple(f for f in features if f not in kept_names),
            dict(zip(kept_names, beta.tolist(), strict=True)),
            np.linalg.inv(matrix) if len(used) else np.zeros((0, 0)),
            {features[i]: centre[i] for i in used}, spark.read.parquet(path), path, last, int(facts["n"]), rounds, converged)
    finally:
        cached.unpersist()
        for p in paths:
            remove(spark, p)


def term_table(spark: SparkSession, model: LevelModel) -> DataFrame:
    """Estimate, standard error, z and p of the numeric terms; aliased terms have nulls."""
    out = []
    for i, name in enumerate(model.kept):
        error = math.sqrt(model.covariance[i, i])
        z = model.estimates[name] / error
        out.append((name, model.estimates[name], error, z, math.erfc(abs(z) / math.sqrt(2.0))))
    out += [(name, None, None, None, None) for name in model.aliased]
    return spark.createDataFrame(out, "term string, estimate double, std_error double, z_value double, p_value double")


def level_table(model: LevelModel, base: object) -> DataFrame:
    """``level, n, n_yes, separated, estimate, std_error, z_value`` of every level against a base level.

    Separated levels have no estimate; the base level itself has estimate 0 and no error.
    """
    first = model.effects.filter((F.col("level") == F.lit(base)) & ~F.col("separated")).first()
    if first is None:
        raise ValueError(f"base level {base!r} does not occur with both labels in {model.category}")
    p = len(model.kept)
    lean = [F.col(f"_b{i}") / F.col("weight") - F.lit(first[f"_b{i}"] / first["weight"]) for i in range(p)]
    variance = 1.0 / F.col("weight") + F.lit(1.0 / first["weight"])
    for i in range(p):
        for j in range(p):
            variance = variance + lean[i] * lean[j] * F.lit(float(model.covariance[i, j]))
    other = F.col("level") != F.lit(base)
    estimate = F.when(other, F.col("effect") - F.lit(first["effect"])).when(~F.col("separated"), 0.0)
    error = F.when(other, F.sqrt(variance))
    return model.effects.select("level", "n", F.col("n_yes").cast("bigint").alias("n_yes"), "separated",
                                estimate.alias("estimate"), error.alias("std_error"), (estimate / error).alias("z_value"))


def predicted(df: DataFrame, model: LevelModel, name: str = "probability") -> DataFrame:
    """The rows with their fitted probability; null for levels that were not seen and for missing features."""
    groups = model.effects.select(F.col("level").alias(model.category), "n", "effect", "n_yes", "separated").select(
        model.category, "n", F.struct("effect", (F.col("n_yes") > 0).cast("double").alias("sure"), "separated").alias("_fit"))
    joined = join_group_values(df, groups, [model.category], "n")
    eta = F.col("_fit.effect")
    for term in model.kept:
        eta = eta + (F.col(quoted(term)).cast("double") - F.lit(model.centres[term])) * F.lit(model.estimates[term])
    value = F.when(F.col("_fit.separated"), F.col("_fit.sure")).otherwise(1.0 / (1.0 + F.exp(-eta)))
    return joined.withColumn(name, value).drop("_fit")
