import numpy as np
import pytest
from pyspark.sql import functions as F

from claimbook.operators import correlation, crossval, glm, lasso, pca
from claimbook.operators.gram import cross_products, independent_columns

N = 400


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, 3))
    x[:, 2] = 0.7 * x[:, 0] + 0.5 * x[:, 2]
    cat = rng.integers(0, 3, N)
    eta = -0.8 + 1.1 * x[:, 0] - 0.6 * x[:, 1] + 0.5 * (cat == 1)
    y = (rng.random(N) < 1 / (1 + np.exp(-eta))).astype(int)
    return x, cat, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, cat, y = data
    rows = [
        (i, *map(float, x[i]), "abc"[cat[i]], int(y[i]), float(x[i, 0] + x[i, 1]), 1.0)
        for i in range(N)
    ]
    ddl = "id int, x0 double, x1 double, x2 double, cat string, y int, both double, one double"
    return spark.createDataFrame(rows, ddl).repartition(5).cache()


def design(data):
    x, cat, _ = data
    return np.column_stack([np.ones(N), x, cat == 1, cat == 2]).astype(float)


def irls(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(info))), info, p


TERMS = ["(Intercept)", "x0", "x1", "x2", "catb", "catc"]
FEATURES = ["x0", "x1", "x2", "cat"]


def test_cross_products_per_group(table, data):
    x, _, _ = data
    got = cross_products(table, [F.col("x0"), F.col("x1")], F.col("id") % 3, F.col("x2") * F.col("x2"))
    for g in range(3):
        pick = np.arange(N) % 3 == g
        b = x[pick, :2]
        np.testing.assert_allclose(got[g], b.T @ (b * x[pick, 2:3] ** 2), rtol=1e-10)


def test_aliased_columns_are_found_in_order():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 3))
    m = np.column_stack([np.ones(50), a[:, 0], a[:, 1], a[:, 0] + a[:, 1], np.full(50, 4.0), a[:, 2]])
    assert independent_columns(m.T @ m) == [0, 1, 2, 5]


def test_logistic_inference_matches_newton(spark, table, data):
    beta, se, info, p = irls(design(data), data[2])
    model = glm.fit_glm(table, "y", FEATURES, {"cat": None})
    got = {r["term"]: r for r in glm.glm_table(spark, model).collect()}
    for t, b, s in zip(TERMS, beta, se):
        assert got[t]["estimate"] == pytest.approx(b, abs=1e-6)
        assert got[t]["std_error"] == pytest.approx(s, rel=1e-5)
        assert got[t]["z_value"] == pytest.approx(b / s, rel=1e-4)
    y = data[2]
    deviance = -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    facts = glm.fit_statistics(table, model).first()
    assert facts["deviance"] == pytest.approx(deviance, rel=1e-8)
    assert facts["aic"] == pytest.approx(deviance + 12, rel=1e-8)
    rate = y.mean()
    null = -2 * N * (rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
    assert facts["null_deviance"] == pytest.approx(null, rel=1e-8)
    cov = np.linalg.inv(info)[1:, 1:]
    want = dict(zip(TERMS[1:], np.diag(cov) * np.diag(np.linalg.inv(cov))))
    for r in glm.vif(table, model).collect():
        assert r["vif"] == pytest.approx(want[r["term"]], rel=1e-5)
    scaled = glm.importance(spark, model, scale=True).collect()
    assert scaled[0]["importance"] == 100.0 and scaled[-1]["importance"] == 0.0


def test_redundant_terms_are_reported_not_fitted(spark, table):
    model = glm.fit_glm(table, "y", ["x0", "x1", "both", "one"])
    assert model.aliased == ("both", "one")
    got = {r["term"]: r["estimate"] for r in glm.glm_table(spark, model).collect()}
    assert got["both"] is None and got["x0"] is not None


def test_base_level_can_be_chosen(table):
    design = glm.build_design(table, "y", ["cat"], {"cat": "c"})
    assert list(design.terms()) == ["cata", "catb"]
    with pytest.raises(ValueError):
        glm.build_design(table, "y", ["cat"], {"cat": "zz"})


def test_cross_validation_matches_refits(table, data):
    folded = table.withColumn("f", F.col("id") % 4)
    run = crossval.cross_validate(folded, "id", "y", FEATURES, {"cat": None}, k=4, fold="f")
    got = {r["id"]: r for r in run.predictions.collect()}
    assert len(got) == N
    x, y = design(data), data[2]
    for f in range(4):
        train, held = np.arange(N) % 4 != f, np.flatnonzero(np.arange(N) % 4 == f)
        beta, *_ = irls(x[train], y[train])
        want = 1 / (1 + np.exp(-x[held] @ beta))
        np.testing.assert_allclose([got[i]["probability"] for i in held], want, atol=1e-6)
        assert all(got[i]["obs"] == ("Yes" if y[i] else "No") for i in held)
    stats = crossval.confusion_statistics(run.predictions).first()
    p = np.array([got[i]["probability"] > 0.5 for i in range(N)])
    accuracy = np.mean(p == y)
    chance = p.mean() * y.mean() + (1 - p.mean()) * (1 - y.mean())
    assert stats["accuracy"] == pytest.approx(accuracy)
    assert stats["kappa"] == pytest.approx((accuracy - chance) / (1 - chance))
    cells = crossval.confusion(run.predictions).collect()
    assert sum(r["share"] for r in cells) == pytest.approx(1.0)
    assert len(crossval.fold_metrics(run.predictions).collect()) == 4


def test_decision_is_strictly_above_the_threshold(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,)], "probability double")
    assert [r["pred"] for r in crossval.decide(df).collect()] == ["No", "Yes"]


def test_folds_are_stable_and_even(spark):
    ids = spark.range(5000).withColumnRenamed("id", "k")
    first = crossval.assign_folds(ids, "k", 10, 3)
    again = crossval.assign_folds(ids.repartition(7), "k", 10, 3)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    sizes = [r["count"] for r in first.groupBy("fold").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 400


def soft(v, t):
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def plain_lasso(x, y, lam):
    mean, sd = x.mean(0), x.std(0)
    z, c = (x - mean) / sd, y - y.mean()
    b = np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(b)):
            b[j] = soft(z[:, j] @ (c - z @ b + z[:, j] * b[j]) / len(y), lam)
    return y.mean() - (b / sd) @ mean, b / sd


def test_lasso_search_matches_direct_fits(table, data):
    x, y = design(data)[:, 1:], data[2].astype(float)
    folded = table.withColumn("f", F.col("id") % 5)
    path = lasso.lasso_path(folded, "id", "y", FEATURES, {"cat": None}, 5, 12, 1e-2, fold="f")
    assert path.lambdas[0] == pytest.approx(
        np.max(np.abs(((x - x.mean(0)) / x.std(0)).T @ (y - y.mean()))) / N
    )
    fold = np.arange(N) % 5
    for s in (0, 4, 11):
        errors = []
        for f in range(5):
            a, b = plain_lasso(x[fold != f], y[fold != f], path.lambdas[s])
            errors.append(np.mean((y[fold == f] - a - x[fold == f] @ b) ** 2))
        assert path.errors[s] == pytest.approx(np.mean(errors), abs=1e-8)
        want_sd = np.sqrt(np.mean((np.array(errors) - np.mean(errors)) ** 2) / 4)
        assert path.error_sds[s] == pytest.approx(want_sd, abs=1e-8)
    assert path.lambda_1se >= path.lambda_min
    assert path.n_nonzero[0] == 0


def test_l1_logistic_satisfies_its_optimality_conditions(table, data):
    x, y = design(data)[:, 1:], data[2]
    lam = 0.03
    got = lasso.lasso_coefficients(table, "y", FEATURES, lam, {"cat": None})
    b = np.array([got[t] for t in TERMS[1:]])
    # the intercept follows from the first-order condition of the unpenalised term
    a = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a + x @ b)))
        a += np.sum(y - p) / np.sum(p * (1 - p))
    gradient = (x / x.std(0)).T @ (y - 1 / (1 + np.exp(-(a + x @ b)))) / N
    for g, v in zip(gradient, b):
        if v == 0:
            assert abs(g) <= lam + 1e-4
        else:
            assert g == pytest.approx(np.sign(v) * lam, abs=1e-4)
    kept = lasso.lasso_select(table, "y", FEATURES, lam, {"cat": None})
    assert kept == [t for t in TERMS[1:] if got[t] != 0] and "x0" in kept


def test_correlations_and_constant_columns(table, data):
    got = {(r["a"], r["b"]): r["r"] for r in correlation.correlations(table, ["x0", "x2", "one"]).collect()}
    assert got["x0", "x2"] == pytest.approx(np.corrcoef(data[0][:, 0], data[0][:, 2])[0, 1])
    assert got["x0", "one"] is None
    assert correlation.pair_correlation(table, "x0", "one").first()["r"] is None


def test_top_pairs_lists_each_pair_once(table):
    corr = correlation.correlations(table, ["x0", "x2", "both"])
    got = correlation.top_pairs(corr, 0.5).collect()
    assert all(r["a"] < r["b"] for r in got)
    assert [abs(r["r"]) for r in got] == sorted((abs(r["r"]) for r in got), reverse=True)


def test_correlation_filter_leaves_no_pair_above_the_cutoff(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3))
    x = np.column_stack([base, base[:, 0] + 0.1 * rng.normal(size=300), base[:, 0] + base[:, 1]])
    names = [f"v{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    dropped = correlation.drop_correlated(correlation.correlations(df, names), 0.6)
    left = [i for i, n in enumerate(names) if n not in dropped]
    r = np.abs(np.corrcoef(x[:, left].T)) - np.eye(len(left))
    assert r.max() <= 0.6 and 0 < len(dropped) < 4
    twins = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "a double, b double")
    assert len(correlation.drop_correlated(correlation.correlations(twins, ["a", "b"]))) == 1


def test_components_match_the_singular_values(table, data):
    x = data[0]
    model = pca.fit_pca(table, ["x0", "x1", "x2"], 2, "pc")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    np.testing.assert_allclose(model.shares, s**2 / np.sum(s**2), rtol=1e-9)
    got = {r["id"]: (r["pc1"], r["pc2"]) for r in pca.pca_scores(model, table).collect()}
    scores = np.array([got[i] for i in range(N)])
    np.testing.assert_allclose(np.abs(scores), np.abs(z @ vt.T[:, :2]), atol=1e-8)
    assert all(model.loadings[np.argmax(np.abs(model.loadings[:, j])), j] > 0 for j in range(3))


def test_constant_columns_are_refused(table):
    with pytest.raises(ValueError, match="one"):
        pca.fit_pca(table, ["x0", "one"], 1)


def test_families_are_replaced(table):
    scored, models = pca.replace_with_scores(table, {"pa": (["x0", "x1"], 1), "pb": (["x2", "both"], 2)})
    assert set(scored.columns) == {"id", "cat", "y", "one", "pa1", "pb1", "pb2"}
    assert set(models) == {"pa", "pb"}


def test_columns_far_from_zero_are_not_taken_for_the_intercept(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(2e6, 50, 800), rng.normal(1.6e9, 1e4, 800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(x - 2e6) / 50))).astype(int)
    df = spark.createDataFrame(
        [(int(a), float(b), float(c), float(2 * c - 7)) for a, b, c in zip(y, x, z)], "y int, x double, z double, w double")
    model = glm.fit_glm(df, "y", ["x", "z", "w"])
    assert model.kept == ("x", "z") and model.aliased == ("w",)
    assert model.coefficients["x"] == pytest.approx(1 / 50, rel=0.3)


def test_the_penalty_search_does_not_depend_on_the_origin(spark):
    rng = np.random.default_rng(5)
    data = [(i, int(rng.random() < 0.4), float(rng.normal()), float(rng.normal())) for i in range(300)]
    near = spark.createDataFrame(data, "k int, y int, a double, b double")
    far = near.selectExpr("k", "y", "a + 5e7 AS a", "b - 3e7 AS b")
    one, two = (lasso.lasso_path(d, "k", "y", ["a", "b"], k=5, n_lambda=20) for d in (near, far))
    np.testing.assert_allclose(one.errors, two.errors, rtol=1e-6)


@pytest.mark.parametrize("stray", [None, 10, -1])
def test_rows_without_a_proper_fold_are_refused(spark, stray):
    rows = [(i, i % 2, float(i % 7), i % 10) for i in range(100)] + [(100, 1, 2.0, stray)]
    df = spark.createDataFrame(rows, "k int, y int, x double, f int")
    with pytest.raises(ValueError, match="1 rows have a fold"):
        crossval.cross_validate(df, "k", "y", ["x"], fold="f")


def test_no_decision_without_a_probability(spark):
    df = spark.createDataFrame([(0.7,), (0.2,), (None,)], "probability double")
    assert [r["pred"] for r in crossval.decide(df).collect()] == ["Yes", "No", None]


@pytest.mark.parametrize("per_bucket", [3, 4096])
def test_ranks_follow_the_digests_within_each_group(spark, per_bucket):
    from hashlib import md5

    from claimbook.operators.ranks import hashed_rank

    rows = [(i, ["a", "b", None][i % 3 if i % 5 else 0]) for i in range(500)]
    got = hashed_rank(spark.createDataFrame(rows, "k int, g string").repartition(6), ["g"], ["k"], 4, per_bucket=per_bucket)
    want = {}
    for g in ("a", "b", None):
        members = sorted((md5(f"{k}|4".encode()).hexdigest(), k) for k, x in rows if x == g)
        want |= {k: (g, place) for place, (_, k) in enumerate(members)}
    assert {r["k"]: (r["g"], r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize("k", [2, 10])
def test_stratified_folds_are_even_in_every_class(spark, k):
    rows = [(i, 1 if i % 97 == 0 else None if i % 89 == 0 else 0, "kept") for i in range(3000)]
    table = spark.createDataFrame(rows, "key int, y int, _rank string")
    folded = crossval.stratified_folds(table, "key", "y", k, 5)
    assert folded.columns == ["key", "y", "_rank", "fold"]
    counts = {}
    for r in folded.groupBy("y", "fold").count().collect():
        counts.setdefault(r["y"], []).append(r["count"])
    assert all(len(c) == k and max(c) - min(c) <= 1 for c in counts.values()) and len(counts) == 3
    again = crossval.stratified_folds(table.repartition(7), "key", "y", k, 5)
    assert folded.exceptAll(again).isEmpty()
    balance = crossval.fold_balance(folded, "y").agg(F.sum("n_rows"), F.sum("share")).first()
    assert balance[0] == 3000 and balance[1] == pytest.approx(k)


def test_no_class_is_one_task(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = spark.range(60_000).select("id", F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("y"))
        folded = crossval.stratified_folds(table, "id", "y", 10)
        sizes = [r["count"] for r in folded.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 30_000


def test_stratified_cross_validation_matches_refits(table, data):
    x, _, y = data
    run = crossval.cross_validate(table, "id", "y", ["x0", "x1"], k=4, seed=2, stratified=True)
    got = {r["id"]: (r["fold"], r["probability"]) for r in run.predictions.collect()}
    fold = np.array([got[i][0] for i in range(N)])
    full = np.column_stack([np.ones(N), x[:, :2]])
    for f in range(4):
        beta, *_ = irls(full[fold != f], y[fold != f])
        for i in np.flatnonzero(fold == f):
            assert got[i][1] == pytest.approx(1 / (1 + np.exp(-full[i] @ beta)), abs=1e-6)


def test_model_without_terms(table, data):
    _, _, y = data
    model = glm.fit_glm(table, "y", [])
    rate = y.mean()
    assert model.kept == () and model.converged
    assert model.coefficients["(Intercept)"] == pytest.approx(np.log(rate / (1 - rate)))
    assert model.std_errors["(Intercept)"] == pytest.approx(1 / np.sqrt(N * rate * (1 - rate)))
    assert glm.vif(table, model).count() == 0


@pytest.mark.parametrize("value", [0, 1])
def test_label_of_one_value(table, value):
    only = table.withColumn("y", F.lit(value))
    model = glm.fit_glm(only, "y", [])
    assert not model.converged
    facts = glm.fit_statistics(only, model).first()
    assert facts["deviance"] == pytest.approx(0, abs=1e-6) and facts["n_extreme"] == N
    assert only.select(model.probability().alias("p")).agg(F.avg("p")).first()[0] == pytest.approx(value)


def test_models_over_an_empty_and_a_full_choice_are_compared(table, data):
    x, _, y = data
    specs = [crossval.ModelSpec("none", table, []), crossval.ModelSpec("two", table, ["x0", "x1"])]
    got = {r["model"]: r for r in crossval.compare_models(specs, "id", "y", k=4, seed=1).collect()}
    rate = y.mean()
    null = -2 * N * (rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
    assert got["none"]["deviance"] == pytest.approx(null) and got["none"]["aic"] == pytest.approx(null + 2)
    assert got["none"]["n_terms"] == 1 and got["none"]["max_vif"] is None
    full = np.column_stack([np.ones(N), x[:, :2]])
    beta, *_ = irls(full, y)
    p = 1 / (1 + np.exp(-full @ beta))
    want = -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert got["two"]["deviance"] == pytest.approx(want, rel=1e-6) and got["two"]["n_terms"] == 3
