"""Separation of a 0/1 response: terms and term combinations that predict it without error.

With separated data the likelihood has no maximum: the estimates run off along a direction in
which no row gets a worse prediction. Two scans after a fit find it. The first gives one more
Newton step from the estimates, which is next to nothing after a proper fit and about one unit
along that direction otherwise. The second checks the signs of every row along the step, and
takes each term's range per response value, which shows the terms that separate alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted
from claimbook.operators.glm import Design, GlmModel, complete_rows
from claimbook.operators.gram import cross_products

NONE, QUASI, COMPLETE = "none", "quasi", "complete"


def _kind_alone(low0: Column, high0: Column, low1: Column, high1: Column) -> Column:
    apart = (high0 < low1) | (high1 < low0)
    touching = ((high0 <= low1) | (high1 <= low0)) & (F.greatest(high0, high1) > F.least(low0, low1))
    return F.when(apart, COMPLETE).when(touching, QUASI).otherwise(NONE)


def separating_terms(df: DataFrame, design: Design) -> DataFrame:
    """Terms whose ranges for the two responses do not overlap: ``term, kind``, one scan.

    ``complete`` if the ranges are apart, ``quasi`` if they touch in one value (as an indicator
    does that is only ever set with one response), else ``none``; also ``none`` if a response
    does not occur or the term is constant.
    """
    terms = design.terms()
    y = F.col(quoted(design.label)).cast("double")
    ends = []
    for i, t in enumerate(terms.values()):
        for v in (0, 1):
            picked = F.when(y == v, t)
            ends += [F.min(picked).alias(f"low{v}_{i}"), F.max(picked).alias(f"high{v}_{i}")]
    facts = df.filter(complete_rows(design)).agg(*ends)
    rows = F.array(*[
        F.struct(F.lit(name).alias("term"), _kind_alone(*[F.col(f"{e}{v}_{i}") for v in (0, 1) for e in ("low", "high")]).alias("kind"))
        for i, name in enumerate(terms)])
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def further_step(df: DataFrame, model: GlmModel) -> np.ndarray:
    """Newton step from a model's estimates, intercept first; one scan."""
    y = F.col(quoted(model.design.label)).cast("double")
    eta = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), model.linear()))
    up, down = F.lit(1.0) + F.exp(eta), F.lit(1.0) + F.exp(-eta)
    terms = model.design.terms()
    columns = [F.lit(1.0), *[terms[t] for t in model.kept], F.when(y == 1, down).otherwise(-up)]
    sums = cross_products(df.filter(complete_rows(model.design)), columns, weight=F.lit(1.0) / (up * down))[0]
    info, gradient = sums[:-1, :-1], sums[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(info), 1e-300))
    return np.linalg.lstsq(info / np.outer(scale, scale), gradient / scale, rcond=1e-12)[0] / scale


def separation(df: DataFrame, model: GlmModel, moved: float = 0.05) -> DataFrame:
    """Separation of a fitted model, a row per kept term: ``term, kind, step, alone``.

    ``kind`` is ``complete`` or ``quasi`` for the terms that take part in a separating
    direction, ``none`` for the others; ``step`` is the term's move in its standard deviations,
    ``alone`` what ``separating_terms`` says of the term by itself. A step below ``moved`` is
    none. All terms are ``none`` after a proper fit.
    """
    spark, terms = df.sparkSession, model.design.terms()
    alone = {r["term"]: r["kind"] for r in separating_terms(df, model.design).collect()}
    if not model.kept:
        return spark.createDataFrame([], "term string, kind string, step double, alone string")
    step = further_step(df, model)
    y = F.col(quoted(model.design.label)).cast("double")
    along = F.lit(float(step[0]))
    for t, d in zip(model.kept, step[1:]):
        along = along + terms[t] * F.lit(float(d))
    facts = df.filter(complete_rows(model.design)).select(
        ((F.lit(2.0) * y - 1.0) * along).alias("s"), *[terms[t].alias(f"t{i}") for i, t in enumerate(model.kept)]
    ).agg(F.min("s").alias("low"), F.max("s").alias("high"), *[F.stddev_pop(f"t{i}").alias(f"d{i}") for i in range(len(model.kept))]).first()
    moves = [float(d) * float(facts[f"d{i}"] or 0.0) for i, d in enumerate(step[1:])]
    slack = 1e-3 * max(abs(facts["low"]), abs(facts["high"]), 1e-300)
    separated = max(map(abs, moves)) >= moved and facts["low"] >= -slack and facts["high"] > 0
    kind = COMPLETE if separated and facts["low"] > slack else QUASI
    rows = [
        (t, kind if separated and abs(m) >= moved * max(map(abs, moves)) else NONE, m, alone[t])
        for t, m in zip(model.kept, moves)]
    return spark.createDataFrame(rows, "term string, kind string, step double, alone string")
