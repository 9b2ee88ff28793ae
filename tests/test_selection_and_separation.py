"""Deviance paths, separation, pairwise correlations and fold-wise components against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimbook.operators import correlation, deviance, foldwise, glm, separation

N = 360


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 4)) * [1, 3, 0.2, 1] + [0, 50, -2, 0]
    x[:, 3] = 0.8 * x[:, 0] + 0.6 * x[:, 3]
    y = (rng.random(N) < 1 / (1 + np.exp(-(-1 + 1.2 * x[:, 0] - 0.3 * (x[:, 1] - 50))))).astype(int)
    gap = rng.random((N, 4)) < [0, 0.1, 0.3, 0]
    return x, y, gap


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, gap = data
    rows = [(i, i % 5, int(y[i]), *map(float, x[i]), *[None if g else float(v) for g, v in zip(gap[i], x[i])], float("nan") if i % 9 == 0 else float(x[i, 0])) for i in range(N)]
    ddl = "id int, fold int, y int, " + ", ".join(f"x{j} double" for j in range(4)) + ", " + ", ".join(f"g{j} double" for j in range(4)) + ", nan double"
    return spark.createDataFrame(rows, ddl).repartition(6).cache()


def deviance_of(eta, y):
    return 2 * np.sum(np.logaddexp(0, eta) - y * eta)


def lasso_fit(x, y, lam):
    """Logistic lasso by proximal gradient steps on standardised columns."""
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    beta, rate = np.zeros(z.shape[1]), 4.0 / np.linalg.eigvalsh(z.T @ z / len(z))[-1]
    for _ in range(60_000):
        step = beta + rate * z.T @ (y - 1 / (1 + np.exp(-z @ beta))) / len(z)
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * lam, 0)
        if np.abs(step - beta).max() < 1e-12:
            break
        beta = step
    slope = beta[1:] / sd
    return beta[0] - slope @ mean, slope


def test_deviance_path_matches_direct_fits(table, data):
    x, y, _ = data
    path = deviance.deviance_path(table, "id", "y", [f"x{j}" for j in range(4)], n_lambda=9, smallest=1e-2, fold="fold", block=4)
    z = (x - x.mean(0)) / x.std(0)
    assert path.lambdas[0] == pytest.approx(np.abs(z.T @ (y - y.mean()) / N).max())
    assert path.n_nonzero[0] == 0 and path.n_nonzero[-1] == 4
    fold = np.arange(N) % 5
    for at in (0, 3, 8):
        errors, sizes = [], []
        for f in range(5):
            a, b = lasso_fit(x[fold != f], y[fold != f], path.lambdas[at])
            held = fold == f
            errors.append(deviance_of(a + x[held] @ b, y[held]) / held.sum())
            sizes.append(held.sum())
        mean = np.average(errors, weights=sizes)
        assert path.errors[at] == pytest.approx(mean, abs=1e-6)
        assert path.error_sds[at] == pytest.approx(np.sqrt(np.average((errors - mean) ** 2, weights=sizes) / 4), abs=1e-6)
        np.testing.assert_allclose(path.coefficients[at], lasso_fit(x, y, path.lambdas[at])[1], atol=1e-5)
    best = int(np.argmin(path.errors))
    assert path.lambda_min == path.lambdas[best] and path.lambda_1se >= path.lambda_min
    # a scan serves all folds and the penalties of a block: nine penalties and six sets are 54 models
    assert path.n_scans < 45


def test_constant_columns_have_no_slope_in_a_deviance_path(table):
    odd = table.withColumns({"one": F.lit(1.0), "rare": (F.col("fold") == 2).cast("double")})
    path = deviance.deviance_path(odd, "id", "y", ["x0", "one", "rare"], n_lambda=4, smallest=0.05, fold="fold")
    assert np.all(path.coefficients[:, 1] == 0) and np.isfinite(path.errors).all()
    with pytest.raises(ValueError):
        deviance.deviance_path(table, "id", "y", [], fold="fold")


def test_a_proper_fit_is_not_separated(table):
    model = glm.fit_glm(table, "y", ["x0", "x1", "x3"])
    assert model.converged
    got = separation.separation(table, model).collect()
    assert {r["kind"] for r in got} == {r["alone"] for r in got} == {"none"}
    assert max(abs(r["step"]) for r in got) < 1e-4


def test_an_indicator_of_one_response_is_quasi_separating(table):
    planted = table.withColumn("only", ((F.col("y") == 1) & (F.col("id") % 2 == 0)).cast("int"))
    model = glm.fit_glm(planted, "y", ["x0", "only"])
    got = {r["term"]: r for r in separation.separation(planted, model).collect()}
    assert not model.converged
    assert (got["only"]["kind"], got["only"]["alone"]) == ("quasi", "quasi")
    assert (got["x0"]["kind"], got["x0"]["alone"]) == ("none", "none")


def test_two_terms_that_separate_only_together(table):
    # y is one where a exceeds b; neither tells y by itself
    planted = table.withColumns({"a": F.col("x0"), "b": F.col("x0") - (2 * F.col("y") - 1) * (1 + F.abs("x3"))})
    model = glm.fit_glm(planted, "y", ["a", "b", "x1"])
    got = {r["term"]: r for r in separation.separation(planted, model).collect()}
    assert {got[t]["alone"] for t in got} == {"none"}
    assert got["a"]["kind"] == got["b"]["kind"] == "complete"


def test_ranges_apart_touching_and_constant(spark):
    rows = [(0, 1.0, 1.0, 5.0, 2.0), (0, 2.0, 2.0, 5.0, 3.0), (1, 3.0, 2.0, 5.0, 2.5), (1, 4.0, 7.0, 5.0, 1.0), (1, None, 9.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "y int, apart double, touch double, same double, mixed double")
    got = separation.separating_terms(df, glm.build_design(df, "y", ["apart", "touch", "same", "mixed"]))
    assert {r["term"]: r["kind"] for r in got.collect()} == {"apart": "complete", "touch": "quasi", "same": "none", "mixed": "none"}
    one = separation.separating_terms(df.filter("y = 1"), glm.build_design(df, "y", ["apart"]))
    assert [r["kind"] for r in one.collect()] == ["none"]


def test_pairwise_correlations(table, data):
    x, _, gap = data
    cols = ["x0", "g1", "g2", "nan", "y"]
    values = np.column_stack([x[:, 0], np.where(gap[:, 1], np.nan, x[:, 1]), np.where(gap[:, 2], np.nan, x[:, 2]),
                              np.where(np.arange(N) % 9 == 0, np.nan, x[:, 0]), data[1]])
    for r in correlation.pairwise_correlations(table, cols).collect():
        i, j = cols.index(r["a"]), cols.index(r["b"])
        both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
        assert r["n"] == both.sum()
        assert r["r"] == pytest.approx(np.corrcoef(values[both, i], values[both, j])[0, 1], abs=1e-10)


def test_pairwise_correlations_of_flat_and_empty_pairs(spark):
    rows = [(1.0, None, 1e9 + 1, 3.0), (2.0, None, 1e9 + 2, 3.0), (4.0, 1.0, 1e9 + 4, 3.0), (None, 2.0, None, 3.0)]
    got = correlation.pairwise_correlations(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd"))
    r = {(x["a"], x["b"]): (x["r"], x["n"]) for x in got.collect()}
    assert r["a", "b"] == (None, 1) and r["a", "d"] == (None, 3) and r["b", "b"][0] == pytest.approx(1)
    assert r["a", "c"][0] == pytest.approx(1) and r["a", "c"][1] == 3
    empty = correlation.pairwise_correlations(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()
    assert all(x["r"] is None and x["n"] == 0 for x in empty)


FAMILIES = {"p": (["g0", "g1"], 1), "q": (["g2", "g3", "x1"], 2)}


def plain_components(values, train, k):
    """Means, scores of all rows by the training rows' components."""
    mean = np.nanmean(values[train], axis=0)
    full = np.where(np.isnan(values), mean, values)
    sd = full[train].std(0, ddof=1)
    z = (full - full[train].mean(0)) / sd
    size, load = np.linalg.eigh(np.corrcoef(full[train].T))
    load = load[:, ::-1]
    load = load * np.sign(load[np.argmax(np.round(np.abs(load), 9), 0), np.arange(load.shape[1])])
    return z @ load[:, :k]


def test_components_of_every_fold(table, data):
    x, _, gap = data
    g = np.where(gap, np.nan, x)
    groups = {"p": (g[:, [0, 1]], 1), "q": (np.column_stack([g[:, 2], g[:, 3], x[:, 1]]), 2)}
    found = foldwise.fold_components(table, FAMILIES, "fold")
    got = {r["id"]: r for r in found.held_out(table, "fold").collect()}
    fold = np.arange(N) % 5
    for f in range(5):
        for prefix, (values, k) in groups.items():
            want = plain_components(values, fold != f, k)
            for i in np.flatnonzero(fold == f)[:20]:
                for j in range(k):
                    assert got[i][f"{prefix}{j + 1}"] == pytest.approx(want[i, j], abs=1e-8)
    with pytest.raises(ValueError):
        foldwise.fold_components(table.withColumn("g0", F.lit(2.0)), FAMILIES, "fold")


def test_no_held_out_row_is_in_a_fitted_number(table):
    changed = table.withColumns({c: F.when(F.col("fold") == 3, F.col(c) * 100 + 7).otherwise(F.col(c)) for c in ("g0", "g1", "g2", "g3")})
    a, b = (foldwise.fold_components(t, FAMILIES, "fold").models[3] for t in (table, changed))
    for prefix in FAMILIES:
        np.testing.assert_allclose(a[prefix].mean, b[prefix].mean, rtol=1e-9)
        np.testing.assert_allclose(a[prefix].loadings, b[prefix].loadings, atol=1e-8)


def test_models_over_components_of_every_fold(table, data):
    x, y, gap = data
    g = np.where(gap, np.nan, x)
    run = foldwise.cross_validate_components(table, "id", "y", ["x0"], {"p": (["g1", "g2"], 1)}, fold="fold")
    got = {r["id"]: (r["fold"], r["probability"]) for r in run.predictions.collect()}
    fold = np.arange(N) % 5
    for f in (0, 4):
        score = plain_components(g[:, [1, 2]], fold != f, 1)
        full, train = np.column_stack([np.ones(N), x[:, 0], score[:, 0]]), fold != f
        beta = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-full[train] @ beta))
            beta += np.linalg.solve(full[train].T @ (full[train] * (p * (1 - p))[:, None]), full[train].T @ (y[train] - p))
        for i in np.flatnonzero(fold == f):
            assert got[i] == (f, pytest.approx(1 / (1 + np.exp(-full[i] @ beta)), abs=1e-6))
