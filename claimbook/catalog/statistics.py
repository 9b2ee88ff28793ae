"""Correlation, components and claim models.

Where a model has a closed form (two columns, one categorical feature) the
check SQL states it; the rest is tested against brute force in the test suite.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimbook.catalog import views as v
from claimbook.catalog.household import PAID_COLUMNS, PAID_HISTORY
from claimbook.catalog.registry import query
from claimbook.catalog.views import with_views
from claimbook.operators import correlation, crossval, deviance, foldwise, glm, lasso, levels, pca, separation
from claimbook.plans import households as hh
from claimbook.plans import modelling as mod
from claimbook.sources.scratch import materialize


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _clean(spark, sf_dir):
    return hh.clean_predictors(v.predictors(spark, sf_dir))


def _labelled(spark, sf_dir):
    """Clean predictors with the response."""
    return hh.modelling_table(_clean(spark, sf_dir), v.outcomes(spark, sf_dir))


# ------------------------------------------------------------ correlation


@query(
    "pair_correlation",
    "M1",
    with_views("SELECT round(corr(premium, loss_amount), 8) AS r FROM outcomes"),
)
def pair_correlation(spark, sf_dir):
    table = correlation.pair_correlation(v.outcomes(spark, sf_dir), "premium", "loss_amount")
    return _rounded(table, 8, "r")


# Numeric columns of the raw predictors.
_RAW = (
    *("inforce_ind", "prior_bi", "time_w_carr", "credit_score", "veh_cnt", "veh_own_cnt", "veh_lease_cnt"),
    *("veh_lien_cnt", "cnt_auto", "cnt_mtrcyc", "veh_w_coll_cnt", "veh_w_comp_cnt", "veh_w_ers_cnt", "drvr_cnt"),
    *("cnt_female", "cnt_male", "cnt_married", "cnt_single", "cnt_yth", "min_age", "avg_age", "max_age", "hoh_age"),
    *("min_mon_lic", "avg_mon_lic", "max_mon_lic", "hoh_mon_lic", "cnt_minr_viol", "avg_minr_viol"),
    *("cnt_majr_viol", "avg_majr_viol", "cnt_lic_susp", "fire_ind", "homeowner_ind", "curnt_bi_low", "curnt_bi_upp"),
)


def _pair_sql(a, b):
    flat = f"var_pop({a}) FILTER ({b} IS NOT NULL) < 1e-12 OR var_pop({b}) FILTER ({a} IS NOT NULL) < 1e-12"
    return (f"{{'a': '{a}', 'b': '{b}', 'n': count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL), "
            f"'r': CASE WHEN {flat} THEN NULL ELSE round(covar_pop({a}, {b}) / sqrt(var_pop({a}) FILTER ({b} IS NOT NULL)) "
            f"/ sqrt(var_pop({b}) FILTER ({a} IS NOT NULL)), 8) END}}")


@query(
    "pairwise_correlations",
    "M1 M2",
    with_views(f"""
        SELECT p.a AS a, p.b AS b, p.r AS r, p.n AS n
        FROM (SELECT unnest([{', '.join(_pair_sql(a, b) for a in _RAW for b in _RAW)}]) AS p FROM predictors)"""),
)
def pairwise_correlations(spark, sf_dir):
    """Each pair of raw columns over the households that have both."""
    return _rounded(correlation.pairwise_correlations(v.predictors(spark, sf_dir), _RAW), 8, "r")


# Numeric columns of the feature table, claim history included.
_CORR_COLS = (
    *("inforce_ind", "prior_bi", "time_w_carr", "credit_score", "veh_cnt", "veh_own_cnt", "veh_lease_cnt"),
    *("veh_lien_cnt", "cnt_auto", "cnt_mtrcyc", "veh_w_coll_cnt", "veh_w_comp_cnt", "veh_w_ers_cnt", "drvr_cnt"),
    *("cnt_female", "cnt_male", "cnt_married", "cnt_single", "cnt_yth", "min_age", "avg_age", "max_age", "hoh_age"),
    *("min_mon_lic", "avg_mon_lic", "max_mon_lic", "hoh_mon_lic", "cnt_minr_viol", "avg_minr_viol"),
    *("cnt_majr_viol", "avg_majr_viol", "cnt_lic_susp", "fire_ind", "homeowner_ind", "curnt_bi"),
    *("hoh_married_ind", "prior_insurer_major", "prior_insurer_minor", "prior_insurer_missing"),
    *PAID_COLUMNS,
)
_FEATURES = (
    f"h AS ({PAID_HISTORY}), features AS (SELECT c.*, "
    + ", ".join(f"coalesce(h.{n}, 0) AS {n}" for n in PAID_COLUMNS)
    + " FROM clean c LEFT JOIN h ON c.hhld_id = h.hhld_id)"
)


def _corr_sql(where):
    names = [(a, b) for a in _CORR_COLS for b in _CORR_COLS]
    wide = ", ".join(f"corr({a}, {b}) AS c{i}" for i, (a, b) in enumerate(names))
    keys = ", ".join(f"('c{i}', '{a}', '{b}')" for i, (a, b) in enumerate(names))
    return f"""WITH {_FEATURES}, wide AS (SELECT {wide} FROM features),
        long AS (SELECT k, r FROM wide UNPIVOT INCLUDE NULLS (r FOR k IN (COLUMNS(*)))),
        pairs(k, a, b) AS (VALUES {keys})
        SELECT a, b, CASE WHEN isnan(r) THEN NULL ELSE round(r, 8) END AS r
        FROM pairs JOIN long USING (k) {where}"""


def _features(spark, sf_dir):
    return hh.household_features(v.predictors(spark, sf_dir), v.claims(spark, sf_dir), v.AS_OF)


@query("correlation_matrix", "M2", with_views(_corr_sql("")))
def correlation_matrix(spark, sf_dir):
    return _rounded(correlation.correlations(_features(spark, sf_dir), _CORR_COLS), 8, "r")


@query("correlated_pairs", "M3 U3 F9 L2", with_views(_corr_sql("WHERE a < b AND abs(r) > 0.5")))
def correlated_pairs(spark, sf_dir):
    table = correlation.correlations(_features(spark, sf_dir), _CORR_COLS)
    return _rounded(correlation.top_pairs(table, 0.5), 8, "r")


@query(
    "correlation_filter_three_columns",
    "M4",
    with_views("""
        WITH c AS (SELECT abs(corr(min_age, max_age)) AS ab, abs(corr(min_age, veh_cnt)) AS ac,
                          abs(corr(max_age, veh_cnt)) AS bc FROM clean),
        v AS (SELECT *, (ab + ac) / 2 AS ma, (ab + bc) / 2 AS mb FROM c)
        SELECT CASE WHEN ma > mb THEN 'min_age' WHEN mb > ma THEN 'max_age' ELSE 'min_age' END AS dropped
        FROM v WHERE ab > 0.6"""),
)
def correlation_filter_three_columns(spark, sf_dir):
    table = correlation.correlations(_clean(spark, sf_dir), ("min_age", "max_age", "veh_cnt"))
    return spark.createDataFrame([(c,) for c in correlation.drop_correlated(table, 0.6)], "dropped string")


@query("correlation_filter", "M4")
def correlation_filter(spark, sf_dir):
    """First round: the feature table with claim history."""
    dropped = correlation.drop_correlated(
        correlation.correlations(_features(spark, sf_dir), _CORR_COLS), 0.6
    )
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


@query("correlation_filter_with_scores", "M4")
def correlation_filter_with_scores(spark, sf_dir):
    """Second round: column families replaced by their scores."""
    scored, _ = pca.replace_with_scores(_features(spark, sf_dir), mod.FAMILIES)
    numeric = [c for c, t in scored.dtypes if t in ("int", "double") and c != "hhld_id"]
    dropped = correlation.drop_correlated(correlation.correlations(scored, numeric), 0.6)
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


# --------------------------------------------------------------- components


@query(
    "component_source_correlation",
    "M5",
    with_views("""
        WITH s AS (SELECT avg(min_age) AS m1, stddev_samp(min_age) AS s1,
                          avg(max_age) AS m2, stddev_samp(max_age) AS s2 FROM clean),
        p AS (SELECT min_age, max_age, avg_mon_lic,
                (min_age - m1) / s1 * sqrt(0.5) + (max_age - m2) / s2 * sqrt(0.5) AS pc FROM clean, s)
        SELECT 'min_age' AS name, round(corr(pc, min_age), 8) AS r FROM p
        UNION ALL SELECT 'max_age', round(corr(pc, max_age), 8) FROM p
        UNION ALL SELECT 'avg_mon_lic', round(corr(pc, avg_mon_lic), 8) FROM p"""),
)
def component_source_correlation(spark, sf_dir):
    clean = _clean(spark, sf_dir)
    scored = pca.pca_scores(pca.fit_pca(clean, ["min_age", "max_age"], 1, "age_pc"), clean)
    table = correlation.correlate_with(scored, "age_pc1", ["min_age", "max_age", "avg_mon_lic"])
    return _rounded(table, 8, "r")


@query(
    "component_variance_two_columns",
    "M6 M7",
    with_views("""
        WITH c AS (SELECT abs(corr(cnt_auto, veh_cnt)) AS r FROM clean)
        SELECT CAST(1 AS INTEGER) AS component, round((1 + r) / 2, 8) AS share,
               round((1 + r) / 2, 8) AS cumulative FROM c
        UNION ALL
        SELECT CAST(2 AS INTEGER), round((1 - r) / 2, 8), CAST(1 AS DOUBLE) FROM c"""),
)
def component_variance_two_columns(spark, sf_dir):
    model = pca.fit_pca(_clean(spark, sf_dir), ["cnt_auto", "veh_cnt"], 2)
    return _rounded(pca.pca_variance(spark, model), 8, "share", "cumulative")


def _register_scree(name, family, k):
    @query(f"component_variance_{name}", "M6 M7")
    def component_variance(spark, sf_dir):
        return pca.pca_variance(spark, pca.fit_pca(_clean(spark, sf_dir), family, k))


_register_scree("ages", mod.AGE_FAMILY, len(mod.AGE_FAMILY))
_register_scree("drivers", mod.DRIVER_FAMILY, len(mod.DRIVER_FAMILY))
_register_scree("vehicles", mod.VEHICLE_FAMILY, len(mod.VEHICLE_FAMILY))


@query(
    "component_scores_two_columns",
    "M8 P6 J8",
    with_views("""
        WITH s AS (SELECT avg(cnt_auto) AS m1, stddev_samp(cnt_auto) AS s1,
                          avg(veh_cnt) AS m2, stddev_samp(veh_cnt) AS s2 FROM clean)
        SELECT hhld_id, round(((cnt_auto - m1) / s1 + (veh_cnt - m2) / s2) * sqrt(0.5), 6) AS veh_pc1
        FROM clean, s"""),
)
def component_scores_two_columns(spark, sf_dir):
    clean = _clean(spark, sf_dir)
    model = pca.fit_pca(clean, ["cnt_auto", "veh_cnt"], 1, "veh_pc")
    return _rounded(pca.pca_scores(model, clean).select("hhld_id", "veh_pc1"), 6, "veh_pc1")


@query("families_replaced_by_scores", "M9 M8")
def families_replaced_by_scores(spark, sf_dir):
    scored, _ = pca.replace_with_scores(_clean(spark, sf_dir), mod.FAMILIES)
    return scored


@query(
    "two_families_replaced_by_scores",
    "M9 M8",
    with_views("""
        WITH s AS (SELECT avg(cnt_auto) AS m1, stddev_samp(cnt_auto) AS s1,
                          avg(veh_cnt) AS m2, stddev_samp(veh_cnt) AS s2,
                          avg(min_age) AS m3, stddev_samp(min_age) AS s3,
                          avg(max_age) AS m4, stddev_samp(max_age) AS s4 FROM clean)
        SELECT clean.* EXCLUDE (cnt_auto, veh_cnt, min_age, max_age),
               round(((cnt_auto - m1) / s1 + (veh_cnt - m2) / s2) * sqrt(0.5), 6) AS veh_pc1,
               round(((min_age - m3) / s3 + (max_age - m4) / s4) * sqrt(0.5), 6) AS age_pc1
        FROM clean, s"""),
)
def two_families_replaced_by_scores(spark, sf_dir):
    families = {"veh_pc": (("cnt_auto", "veh_cnt"), 1), "age_pc": (("min_age", "max_age"), 1)}
    scored, _ = pca.replace_with_scores(_clean(spark, sf_dir), families)
    return _rounded(scored, 6, "veh_pc1", "age_pc1")


# ------------------------------------------------------------------- models

_LEVELS = ("Minor_Insurer", "Missing")

# Counts per insurer bucket: the only facts a one-category model depends on.
_BY_LEVEL = """
    l AS (SELECT prior_insurer_bucket AS level, count(*) AS n,
                 CAST(sum(future_clm_ind) AS DOUBLE) AS pos
          FROM clean c JOIN outcomes o ON c.hhld_id = o.hhld_id GROUP BY 1),
    b AS (SELECT * FROM l WHERE level = 'Major_Insurer')"""


@query(
    "design_columns",
    "G2 X19",
    with_views("""
        SELECT hhld_id, future_clm_ind AS label, credit_score,
               CAST(prior_insurer_minor AS DOUBLE) AS minor,
               CAST(prior_insurer_missing AS DOUBLE) AS missing
        FROM clean JOIN outcomes USING (hhld_id)"""),
)
def design_columns(spark, sf_dir):
    table = _labelled(spark, sf_dir)
    design = glm.build_design(
        table,
        "future_clm_ind",
        ["credit_score", "prior_insurer_bucket"],
        {"prior_insurer_bucket": "Major_Insurer"},
    )
    terms = design.terms()
    return table.select(
        "hhld_id",
        F.col("future_clm_ind").alias("label"),
        terms["credit_score"].alias("credit_score"),
        terms["prior_insurer_bucketMinor_Insurer"].alias("minor"),
        terms["prior_insurer_bucketMissing"].alias("missing"),
    )


@query(
    "logistic_one_indicator",
    "G3",
    with_views("""
        WITH t AS (SELECT fire_ind, CAST(sum(future_clm_ind) AS DOUBLE) AS p,
                          CAST(sum(1 - future_clm_ind) AS DOUBLE) AS q
                   FROM predictors JOIN outcomes USING (hhld_id) GROUP BY fire_ind),
        z AS (SELECT p, q FROM t WHERE fire_ind = 0), o AS (SELECT p, q FROM t WHERE fire_ind = 1)
        SELECT '(Intercept)' AS term, round(ln(z.p / z.q), 6) AS estimate,
               round(sqrt(1 / z.p + 1 / z.q), 6) AS std_error FROM z
        UNION ALL
        SELECT 'fire_ind', round(ln(o.p / o.q) - ln(z.p / z.q), 6),
               round(sqrt(1 / z.p + 1 / z.q + 1 / o.p + 1 / o.q), 6) FROM z, o"""),
)
def logistic_one_indicator(spark, sf_dir):
    table = v.predictors(spark, sf_dir).join(v.outcomes(spark, sf_dir), "hhld_id")
    model = glm.fit_glm(table, "future_clm_ind", ["fire_ind"])
    return _rounded(
        glm.glm_table(spark, model).select("term", "estimate", "std_error"),
        6,
        "estimate",
        "std_error",
    )


def _category_model(spark, sf_dir):
    table = _labelled(spark, sf_dir)
    model = glm.fit_glm(
        table,
        "future_clm_ind",
        ["prior_insurer_bucket"],
        {"prior_insurer_bucket": "Major_Insurer"},
    )
    return table, model


@query(
    "logistic_one_category",
    "G3 G2",
    with_views(f"""
        WITH {_BY_LEVEL.strip()}
        SELECT CASE WHEN l.level = 'Major_Insurer' THEN '(Intercept)'
                    ELSE 'prior_insurer_bucket' || l.level END AS term,
               round(ln(l.pos / (l.n - l.pos)) - CASE WHEN l.level = 'Major_Insurer' THEN 0
                     ELSE ln(b.pos / (b.n - b.pos)) END, 6) AS estimate,
               round(sqrt(1 / l.pos + 1 / (l.n - l.pos) + CASE WHEN l.level = 'Major_Insurer' THEN 0
                     ELSE 1 / b.pos + 1 / (b.n - b.pos) END), 6) AS std_error
        FROM l, b"""),
)
def logistic_one_category(spark, sf_dir):
    _, model = _category_model(spark, sf_dir)
    return _rounded(
        glm.glm_table(spark, model).select("term", "estimate", "std_error"),
        6,
        "estimate",
        "std_error",
    )


@query(
    "logistic_fit_statistics",
    "G3",
    with_views(f"""
        WITH {_BY_LEVEL.strip()}, d AS (
          SELECT -2 * sum(pos * ln(pos / n) + (n - pos) * ln(1 - pos / n)) AS deviance,
                 sum(n) AS n, sum(pos) AS pos FROM l)
        SELECT CAST(n AS BIGINT) AS n_rows, round(deviance, 6) AS deviance,
               round(-2 * (pos * ln(pos / n) + (n - pos) * ln(1 - pos / n)), 6) AS null_deviance,
               round(deviance + 6, 6) AS aic FROM d"""),
)
def logistic_fit_statistics(spark, sf_dir):
    table, model = _category_model(spark, sf_dir)
    facts = glm.fit_statistics(table, model)
    return _rounded(
        facts.select("n_rows", "deviance", "null_deviance", "aic"),
        6,
        "deviance",
        "null_deviance",
        "aic",
    )


@query(
    "feature_importance",
    "G10",
    with_views(f"""
        WITH {_BY_LEVEL.strip()}
        SELECT 'prior_insurer_bucket' || l.level AS term,
               round(abs(ln(l.pos / (l.n - l.pos)) - ln(b.pos / (b.n - b.pos)))
                 / sqrt(1 / l.pos + 1 / (l.n - l.pos) + 1 / b.pos + 1 / (b.n - b.pos)), 6)
                 AS importance
        FROM l, b WHERE l.level <> 'Major_Insurer'"""),
)
def feature_importance(spark, sf_dir):
    _, model = _category_model(spark, sf_dir)
    return _rounded(glm.importance(spark, model), 6, "importance")


@query(
    "variance_inflation",
    "G11",
    with_views(f"""
        WITH {_BY_LEVEL.strip()},
        w AS (SELECT level, pos * (1 - pos / n) AS w FROM l),
        s AS (SELECT sum(w) AS t, sum(w) FILTER (level = 'Minor_Insurer') AS a,
                     sum(w) FILTER (level = 'Missing') AS m FROM w),
        r AS (SELECT (a * m / t) * (a * m / t) / ((a - a * a / t) * (m - m * m / t)) AS r2 FROM s)
        SELECT 'prior_insurer_bucket' || level AS term, round(1 / (1 - r2), 6) AS vif, FALSE AS is_high
        FROM r, (VALUES ('Minor_Insurer'), ('Missing')) AS x(level)"""),
)
def variance_inflation(spark, sf_dir):
    table, model = _category_model(spark, sf_dir)
    return _rounded(glm.vif(table, model), 6, "vif")


@query(
    "variance_inflation_unweighted",
    "G11",
    with_views("""
        SELECT term, round(1 / (1 - r * r), 6) AS vif, 1 / (1 - r * r) > 5 AS is_high
        FROM (SELECT corr(cnt_auto, veh_cnt) AS r FROM predictors),
             (VALUES ('cnt_auto'), ('veh_cnt')) AS x(term)"""),
)
def variance_inflation_unweighted(spark, sf_dir):
    table = v.predictors(spark, sf_dir).join(v.outcomes(spark, sf_dir), "hhld_id")
    model = glm.fit_glm(table, "future_clm_ind", ["cnt_auto", "veh_cnt"])
    return _rounded(glm.vif(table, model, weighted=False), 6, "vif")


# ------------------------------------------------------- cross-validation

# Out-of-fold probability of a one-category model: the claim share of the
# household's category in all other folds.
_OOF = """
    f AS (SELECT hhld_id, CAST(hhld_id % 10 AS INTEGER) AS fold, inforce_ind, future_clm_ind
          FROM predictors JOIN outcomes USING (hhld_id)),
    g AS (SELECT fold, inforce_ind, count(*) AS n, sum(future_clm_ind) AS pos FROM f GROUP BY 1, 2),
    q AS (SELECT inforce_ind, sum(n) AS n, sum(pos) AS pos FROM g GROUP BY 1),
    oof AS (SELECT f.hhld_id, f.fold, CASE WHEN f.future_clm_ind = 1 THEN 'Yes' ELSE 'No' END AS obs,
                   round((q.pos - g.pos) / CAST(q.n - g.n AS DOUBLE), 6) AS probability
            FROM f JOIN g ON f.fold = g.fold AND f.inforce_ind = g.inforce_ind
            JOIN q ON f.inforce_ind = q.inforce_ind)"""
_CUT = 0.057


def _oof(spark, sf_dir):
    table = (
        v.predictors(spark, sf_dir)
        .select("hhld_id", "inforce_ind")
        .join(v.outcomes(spark, sf_dir), "hhld_id")
        .withColumn("fold", (F.col("hhld_id") % 10).cast("int"))
    )
    run = crossval.cross_validate(
        table, "hhld_id", "future_clm_ind", ["inforce_ind"], fold="fold"
    )
    return run.predictions.withColumn("probability", F.round("probability", 6))


def _fold_sql(seed):
    return f"CAST(CAST('0x' || substr(md5(hhld_id || '|{seed}'), 1, 8) AS BIGINT) % 10 AS INTEGER)"


@query(
    "hashed_folds",
    "G4",
    with_views(f"SELECT hhld_id, future_clm_ind, {_fold_sql(7)} AS fold FROM outcomes"),
)
def hashed_folds(spark, sf_dir):
    return crossval.assign_folds(
        v.outcomes(spark, sf_dir).select("hhld_id", "future_clm_ind"), "hhld_id", 10, seed=7
    )


# Folds dealt round-robin within each class, in the order of the keys' digests.
_DEALT = """
    dealt AS (SELECT hhld_id, future_clm_ind, CAST((row_number() OVER (
                PARTITION BY future_clm_ind ORDER BY md5(hhld_id || '|7'), hhld_id) - 1) % 10 AS INTEGER) AS fold
              FROM outcomes)"""


def _dealt(spark, sf_dir):
    rows = v.outcomes(spark, sf_dir).select("hhld_id", "future_clm_ind")
    return crossval.stratified_folds(rows, "hhld_id", "future_clm_ind", 10, seed=7)


@query("stratified_folds", "G4", with_views(f"WITH {_DEALT.strip()} SELECT * FROM dealt"))
def stratified_folds(spark, sf_dir):
    return _dealt(spark, sf_dir)


@query(
    "stratified_fold_balance",
    "G4",
    with_views(f"""WITH {_DEALT.strip()}
        SELECT future_clm_ind, fold, count(*) AS n_rows,
               round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY fold) AS DOUBLE), 8) AS share
        FROM dealt GROUP BY 1, 2"""),
)
def stratified_fold_balance(spark, sf_dir):
    return _rounded(crossval.fold_balance(_dealt(spark, sf_dir), "future_clm_ind"), 8, "share")


@query(
    "stratified_out_of_fold",
    "G5 G4",
    with_views(f"""WITH {_DEALT.strip()},
        f AS (SELECT d.*, inforce_ind FROM dealt d JOIN predictors USING (hhld_id)),
        g AS (SELECT fold, inforce_ind, count(*) AS n, sum(future_clm_ind) AS pos FROM f GROUP BY 1, 2),
        q AS (SELECT inforce_ind, sum(n) AS n, sum(pos) AS pos FROM g GROUP BY 1)
        SELECT f.hhld_id, f.fold, CASE WHEN f.future_clm_ind = 1 THEN 'Yes' ELSE 'No' END AS obs,
               round((q.pos - g.pos) / CAST(q.n - g.n AS DOUBLE), 6) AS probability
        FROM f JOIN g ON f.fold = g.fold AND f.inforce_ind = g.inforce_ind
        JOIN q ON f.inforce_ind = q.inforce_ind"""),
)
def stratified_out_of_fold(spark, sf_dir):
    """Out-of-fold probabilities of a one-indicator model over folds dealt within each class."""
    table = v.predictors(spark, sf_dir).select("hhld_id", "inforce_ind").join(v.outcomes(spark, sf_dir), "hhld_id")
    run = crossval.cross_validate(
        table, "hhld_id", "future_clm_ind", ["inforce_ind"], k=10, seed=7, stratified=True
    )
    return _rounded(run.predictions, 6, "probability")


@query(
    "out_of_fold_predictions",
    "G5",
    with_views(f"WITH {_OOF.strip()} SELECT hhld_id, fold, obs, probability FROM oof"),
)
def out_of_fold_predictions(spark, sf_dir):
    return _oof(spark, sf_dir)


@query(
    "class_decisions",
    "G6",
    with_views(f"""WITH {_OOF.strip()}
        SELECT hhld_id, CASE WHEN probability > {_CUT} THEN 'Yes' ELSE 'No' END AS pred FROM oof"""),
)
def class_decisions(spark, sf_dir):
    return crossval.decide(_oof(spark, sf_dir), _CUT).select("hhld_id", "pred")


@query(
    "confusion_matrix",
    "G7 A8",
    with_views(f"""WITH {_OOF.strip()},
        d AS (SELECT obs, CASE WHEN probability > {_CUT} THEN 'Yes' ELSE 'No' END AS pred FROM oof)
        SELECT p.x AS pred, o.x AS obs, count(d.obs) / CAST(10 AS DOUBLE) AS avg_count,
               round(count(d.obs) / CAST((SELECT count(*) FROM d) AS DOUBLE), 6) AS share
        FROM (VALUES ('Yes'), ('No')) p(x) CROSS JOIN (VALUES ('Yes'), ('No')) o(x)
        LEFT JOIN d ON d.pred = p.x AND d.obs = o.x GROUP BY 1, 2"""),
)
def confusion_matrix(spark, sf_dir):
    return _rounded(crossval.confusion(_oof(spark, sf_dir), _CUT), 6, "share")


_STATISTICS = """
    round((tp + tn) / n, 6) AS accuracy,
    round(((tp + tn) / n - e) / nullif(1 - e, 0), 6) AS kappa"""


def _statistics_sql(key):
    group = f"GROUP BY {key}" if key else ""
    lead = f"{key}, " if key else ""
    return f"""WITH {_OOF.strip()},
        d AS (SELECT fold, obs = 'Yes' AS o, probability > {_CUT} AS p FROM oof),
        c AS (SELECT {lead}CAST(count(*) FILTER (p AND o) AS DOUBLE) AS tp,
                CAST(count(*) FILTER (p AND NOT o) AS DOUBLE) AS fp,
                CAST(count(*) FILTER (NOT p AND o) AS DOUBLE) AS fn,
                CAST(count(*) FILTER (NOT p AND NOT o) AS DOUBLE) AS tn,
                CAST(count(*) AS DOUBLE) AS n FROM d {group}),
        x AS (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS e FROM c)"""


@query(
    "confusion_statistics",
    "G7",
    with_views(f"""{_statistics_sql("")}
        SELECT {_STATISTICS}, round(tp / nullif(tp + fn, 0), 6) AS sensitivity,
               round(tn / nullif(tn + fp, 0), 6) AS specificity,
               round(tp / nullif(tp + fp, 0), 6) AS pos_pred_value,
               round(tn / nullif(tn + fn, 0), 6) AS neg_pred_value,
               round((tp + fn) / n, 6) AS prevalence, round(tp / n, 6) AS detection_rate,
               round((tp + fp) / n, 6) AS detection_prevalence,
               round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy
        FROM x"""),
)
def confusion_statistics(spark, sf_dir):
    table = crossval.confusion_statistics(_oof(spark, sf_dir), _CUT)
    return _rounded(table, 6, *table.columns)


@query(
    "probability_distribution",
    "G8 H4",
    with_views(f"""WITH {_OOF.strip()},
        d AS (SELECT obs, CASE WHEN probability > {_CUT} THEN 'Yes' ELSE 'No' END AS pred,
                     probability AS x FROM oof),
        r AS (SELECT min(x) AS lo, (max(x) - min(x)) / CAST(30 AS DOUBLE) AS step FROM d),
        h AS (SELECT pred, obs, least(CAST(floor((x - lo) / step) AS BIGINT), 29) AS bin,
                     count(*) AS n FROM d, r GROUP BY ALL),
        s AS (SELECT pred, obs, CAST(range AS BIGINT) AS bin
              FROM (SELECT DISTINCT pred, obs FROM d), range(30))
        SELECT s.pred, s.obs, s.bin, coalesce(n, 0) AS n_rows,
               round(coalesce(n, 0) / CAST((SELECT count(*) FROM d) AS DOUBLE), 6) AS share
        FROM s LEFT JOIN h ON h.pred = s.pred AND h.obs = s.obs AND h.bin = s.bin"""),
)
def probability_distribution(spark, sf_dir):
    table = crossval.probability_histogram(_oof(spark, sf_dir), _CUT)
    return _rounded(table.drop("bin_start", "bin_end"), 6, "share")


@query(
    "fold_metrics",
    "G9 G7",
    with_views(f"""{_statistics_sql("fold")} SELECT fold, {_STATISTICS} FROM x"""),
)
def fold_metrics(spark, sf_dir):
    table = crossval.fold_metrics(_oof(spark, sf_dir), _CUT)
    return _rounded(table, 6, "accuracy", "kappa")


# ------------------------------------------- fold-wise components, separation


@query(
    "fold_component_scores",
    "M6 M8 G5",
    with_views("""
        WITH f AS (SELECT hhld_id, CAST(hhld_id % 10 AS INTEGER) AS fold, CAST(credit_score AS DOUBLE) AS x,
                          CAST(avg_age AS DOUBLE) AS y FROM predictors),
        h AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, CAST(count(x) AS DOUBLE) AS nx, CAST(count(y) AS DOUBLE) AS ny,
                     sum(x) AS sx, sum(y) AS sy FROM f GROUP BY fold),
        m AS (SELECT h.fold, a.n - h.n AS n, (a.sx - h.sx) / (a.nx - h.nx) AS mx, (a.sy - h.sy) / (a.ny - h.ny) AS my
              FROM h, (SELECT sum(n) AS n, sum(nx) AS nx, sum(ny) AS ny, sum(sx) AS sx, sum(sy) AS sy FROM h) a),
        d AS (SELECT m.fold, m.mx, m.my, sqrt(sum(power(coalesce(x, mx) - mx, 2)) / (max(m.n) - 1)) AS dx,
                     sqrt(sum(power(coalesce(y, my) - my, 2)) / (max(m.n) - 1)) AS dy,
                     sign(sum((coalesce(x, mx) - mx) * (coalesce(y, my) - my))) AS s
              FROM m JOIN f ON f.fold <> m.fold GROUP BY 1, 2, 3)
        SELECT hhld_id, f.fold, round(((coalesce(x, mx) - mx) / dx + s * (coalesce(y, my) - my) / dy) / sqrt(2), 6) AS pc1
        FROM f JOIN d ON f.fold = d.fold"""),
)
def fold_component_scores(spark, sf_dir):
    """First component of two columns with gaps; in closed form the scaled columns' sum or difference."""
    rows = v.predictors(spark, sf_dir).select(
        "hhld_id", "credit_score", "avg_age", (F.col("hhld_id") % 10).cast("int").alias("fold"))
    found = foldwise.fold_components(rows, {"pc": (["credit_score", "avg_age"], 1)}, "fold")
    return _rounded(found.held_out(rows, "fold").select("hhld_id", "fold", "pc1"), 6, "pc1")


@query("components_in_each_fold", "G5 M9 G4")
def components_in_each_fold(spark, sf_dir):
    """Out-of-fold probabilities with all families replaced by scores that their own fold had no part in."""
    table = _labelled(spark, sf_dir).withColumn("hoh_married_ind", F.col("hoh_married_ind").cast("double"))
    run = foldwise.cross_validate_components(
        table, "hhld_id", "future_clm_ind", ["prior_bi", "credit_score", "inforce_ind"], mod.FAMILIES, k=10, seed=7)
    return run.predictions


@query(
    "separating_terms",
    "G3",
    with_views("""
        WITH t AS (SELECT future_clm_ind AS y, x.* FROM predictors JOIN outcomes USING (hhld_id),
                   LATERAL (VALUES ('credit_score', CAST(credit_score AS DOUBLE)), ('inforce_ind', CAST(inforce_ind AS DOUBLE)),
                     ('only_with', CAST(inforce_ind * future_clm_ind AS DOUBLE)), ('after', 3.0 * future_clm_ind + veh_cnt / 50.0)) x(term, v)
                   WHERE credit_score IS NOT NULL AND inforce_ind IS NOT NULL AND veh_cnt IS NOT NULL),
        e AS (SELECT term, min(v) FILTER (y = 0) AS l0, max(v) FILTER (y = 0) AS h0, min(v) FILTER (y = 1) AS l1,
                     max(v) FILTER (y = 1) AS h1 FROM t GROUP BY term)
        SELECT term, CASE WHEN h0 < l1 OR h1 < l0 THEN 'complete'
                          WHEN (h0 <= l1 OR h1 <= l0) AND greatest(h0, h1) > least(l0, l1) THEN 'quasi' ELSE 'none' END AS kind
        FROM e"""),
)
def separating_terms(spark, sf_dir):
    """Two plain terms, an indicator that is only set with a claim, and one beyond all others with a claim."""
    return separation.separating_terms(*_separable(spark, sf_dir))


def _separable(spark, sf_dir):
    table = v.predictors(spark, sf_dir).join(v.outcomes(spark, sf_dir), "hhld_id").withColumns({
        "only_with": F.col("inforce_ind") * F.col("future_clm_ind"),
        "after": 3.0 * F.col("future_clm_ind") + F.col("veh_cnt") / 50.0})
    return table, glm.build_design(table, "future_clm_ind", ["credit_score", "inforce_ind", "only_with", "after"])


@query("separated_model", "G3")
def separated_model(spark, sf_dir):
    """What a fit with an indicator that is only set with a claim says of its terms."""
    table, _ = _separable(spark, sf_dir)
    model = glm.fit_glm(table, "future_clm_ind", ["credit_score", "inforce_ind", "only_with"])
    return separation.separation(table, model).withColumn("converged", F.lit(model.converged))


# ------------------------------------------------ reports and model selection


def _final_report(spark, sf_dir):
    return crossval.evaluate_glm(
        _labelled(spark, sf_dir), "hhld_id", "future_clm_ind", mod.FINAL_FEATURES, k=10
    )


@query("model_report_coefficients", "G12 G3")
def model_report_coefficients(spark, sf_dir):
    report = _final_report(spark, sf_dir)
    return report["coefficients"].join(report["vif"], "term", "left")


def _register_report(part):
    @query(f"model_report_{part}", "G12")
    def model_report(spark, sf_dir):
        return _final_report(spark, sf_dir)[part]


for _part in ("fit", "importance", "predictions", "confusion", "statistics", "probabilities", "folds"):
    _register_report(_part)


def _full(spark, sf_dir):
    """The whole modelling table, scores and history included, and its feature names."""
    table = materialize(
        mod.full_table(
            v.predictors(spark, sf_dir), v.claims(spark, sf_dir), v.outcomes(spark, sf_dir), v.AS_OF
        )
    )
    return table, mod.features_of(table)


_PENALTY = 0.002


@query(
    "lasso_error_curve_one_indicator",
    "G13",
    with_views("""
        WITH f AS (SELECT CAST(hhld_id % 10 AS INTEGER) AS fold, CAST(inforce_ind AS DOUBLE) AS x,
                          CAST(future_clm_ind AS DOUBLE) AS y
                   FROM predictors JOIN outcomes USING (hhld_id)),
        h AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx,
                     sum(x * y) AS sxy, sum(y * y) AS syy FROM f GROUP BY fold),
        a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM h),
        top AS (SELECT abs((sxy / n - sx / n * sy / n) / sqrt(sxx / n - sx / n * sx / n)) AS top FROM a),
        grid AS (SELECT j, top * power(CAST(10 AS DOUBLE), -4.0 * j / 99) AS lam FROM top, range(100) AS r(j)),
        t AS (SELECT h.*, (a.sx - h.sx) / (a.n - h.n) AS mx, (a.sy - h.sy) / (a.n - h.n) AS my,
                     (a.sxx - h.sxx) / (a.n - h.n) AS mxx, (a.sxy - h.sxy) / (a.n - h.n) AS mxy FROM h, a),
        m AS (SELECT *, sqrt(mxx - mx * mx) AS sd, (mxy - mx * my) / sqrt(mxx - mx * mx) AS c FROM t),
        b AS (SELECT j, lam, m.*, sign(c) * greatest(abs(c) - lam, 0) / sd AS beta FROM m, grid),
        e AS (SELECT j, lam, n, (syy - 2 * (my - beta * mx) * sy - 2 * beta * sxy
                       + n * (my - beta * mx) * (my - beta * mx) + 2 * (my - beta * mx) * beta * sx
                       + beta * beta * sxx) / n AS err FROM b),
        w AS (SELECT j, lam, sum(n * err) / sum(n) AS cv FROM e GROUP BY j, lam)
        SELECT round(w.lam, 8) AS "lambda", round(cv, 8) AS cv_error,
               round(sqrt(sum(n * (err - cv) * (err - cv)) / sum(n) / 9), 8) AS cv_sd,
               CAST(CASE WHEN w.j = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_nonzero
        FROM w JOIN e ON w.j = e.j GROUP BY w.j, w.lam, cv"""),
)
def lasso_error_curve_one_indicator(spark, sf_dir):
    table = (
        v.predictors(spark, sf_dir).select("hhld_id", "inforce_ind")
        .join(v.outcomes(spark, sf_dir), "hhld_id")
        .withColumn("fold", (F.col("hhld_id") % 10).cast("int"))
    )
    path = lasso.lasso_path(table, "hhld_id", "future_clm_ind", ["inforce_ind"], k=10, fold="fold")
    return _rounded(path.table(spark), 8, "lambda", "cv_error", "cv_sd")


@query(
    "lasso_deviance_curve_one_indicator",
    "G13 G14",
    with_views("""
        WITH f AS (SELECT CAST(hhld_id % 10 AS INTEGER) AS fold, inforce_ind AS x, future_clm_ind AS y
                   FROM predictors JOIN outcomes USING (hhld_id)),
        h AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS n1,
                     CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(x * y) AS DOUBLE) AS pos1 FROM f GROUP BY fold),
        a AS (SELECT sum(n) AS n, sum(n1) AS n1, sum(pos) AS pos, sum(pos1) AS pos1 FROM h),
        top AS (SELECT abs(pos1 / n - n1 / n * pos / n) / sqrt(n1 / n * (1 - n1 / n)) AS top FROM a),
        grid AS (SELECT j, top * power(CAST(10 AS DOUBLE), -4.0 * j / 39) AS lam FROM top, range(40) AS r(j)),
        t AS (SELECT h.*, (a.n1 - h.n1) / (a.n - h.n) AS q, (a.pos1 - h.pos1) / (a.n1 - h.n1) AS r1,
                     (a.pos - a.pos1 - h.pos + h.pos1) / (a.n - a.n1 - h.n + h.n1) AS r0,
                     (a.pos - h.pos) / (a.n - h.n) AS rate FROM h, a),
        p AS (SELECT *, sign(r1 - r0) AS s, lam * sqrt(q * (1 - q)) AS pull FROM t, grid),
        m AS (SELECT *, r1 - s * pull / q AS p1, r0 + s * pull / (1 - q) AS p0 FROM p),
        c AS (SELECT fold, j, lam, n, n1, pos, pos1, CASE WHEN s * (p1 - p0) > 0 THEN p1 ELSE rate END AS p1,
                     CASE WHEN s * (p1 - p0) > 0 THEN p0 ELSE rate END AS p0 FROM m),
        e AS (SELECT j, lam, n, -2 * (pos1 * ln(p1) + (n1 - pos1) * ln(1 - p1) + (pos - pos1) * ln(p0)
                       + (n - n1 - pos + pos1) * ln(1 - p0)) / n AS err FROM c),
        w AS (SELECT j, lam, sum(n * err) / sum(n) AS cv FROM e GROUP BY j, lam)
        SELECT round(w.lam, 8) AS "lambda", round(cv, 6) AS cv_error,
               round(sqrt(sum(n * (err - cv) * (err - cv)) / sum(n) / 9), 6) AS cv_sd,
               CAST(CASE WHEN w.j = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_nonzero
        FROM w JOIN e ON w.j = e.j GROUP BY w.j, w.lam, cv"""),
)
def lasso_deviance_curve_one_indicator(spark, sf_dir):
    """Held-out deviance per penalty; in closed form each group's rate is moved towards the other."""
    table = (
        v.predictors(spark, sf_dir).select("hhld_id", "inforce_ind")
        .join(v.outcomes(spark, sf_dir), "hhld_id")
        .withColumn("fold", (F.col("hhld_id") % 10).cast("int"))
    )
    path = deviance.deviance_path(
        table, "hhld_id", "future_clm_ind", ["inforce_ind"], n_lambda=40, fold="fold", block=40
    )
    return _rounded(_rounded(path.table(spark), 8, "lambda"), 6, "cv_error", "cv_sd")


@query(
    "lasso_one_indicator",
    "G14",
    with_views(f"""
        WITH g AS (SELECT count(*) AS n, avg(CAST(inforce_ind AS DOUBLE)) AS q,
                     avg(CAST(future_clm_ind AS DOUBLE)) FILTER (inforce_ind = 1) AS r1,
                     avg(CAST(future_clm_ind AS DOUBLE)) FILTER (inforce_ind = 0) AS r0
                   FROM predictors JOIN outcomes USING (hhld_id)),
        p AS (SELECT *, sign(r1 - r0) AS s, {_PENALTY} * sqrt(q * (1 - q)) AS pull FROM g),
        k AS (SELECT *, r1 - s * pull / q AS p1, r0 + s * pull / (1 - q) AS p0 FROM p)
        SELECT 'inforce_ind' AS term,
               CASE WHEN s * (p1 - p0) > 0 THEN round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) ELSE 0 END AS estimate
        FROM k"""),
)
def lasso_one_indicator(spark, sf_dir):
    """Each group's rate is moved towards the other by the penalty; the slope is their log odds apart."""
    values = lasso.lasso_coefficients(
        _labelled(spark, sf_dir), "future_clm_ind", ["inforce_ind"], _PENALTY
    )
    return spark.createDataFrame([(t, round(c, 4)) for t, c in values.items()], "term string, estimate double")


@query(
    "model_comparison_one_indicator",
    "G17 G12",
    with_views(f"""
        WITH f AS (SELECT {_fold_sql(0)} AS fold, inforce_ind, future_clm_ind
                   FROM predictors JOIN outcomes USING (hhld_id)),
        g AS (SELECT fold, inforce_ind, count(*) AS n, sum(future_clm_ind) AS pos FROM f GROUP BY 1, 2),
        q AS (SELECT inforce_ind, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(pos) AS DOUBLE) AS pos FROM g GROUP BY 1),
        l AS (SELECT -2 * sum(pos * ln(pos / n) + (n - pos) * ln(1 - pos / n)) AS deviance FROM q),
        o AS (SELECT (q.pos - g.pos) / (q.n - g.n) > 0.5 AS yes, g.n, g.pos
              FROM g JOIN q ON g.inforce_ind = q.inforce_ind),
        c AS (SELECT CAST(sum(CASE WHEN yes THEN pos ELSE 0 END) AS DOUBLE) AS tp,
                     CAST(sum(CASE WHEN yes THEN n - pos ELSE 0 END) AS DOUBLE) AS fp,
                     CAST(sum(CASE WHEN yes THEN 0 ELSE pos END) AS DOUBLE) AS fn,
                     CAST(sum(CASE WHEN yes THEN 0 ELSE n - pos END) AS DOUBLE) AS tn FROM o),
        x AS (SELECT *, tp + fp + fn + tn AS n,
                ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / power(tp + fp + fn + tn, 2) AS e FROM c)
        SELECT 'in-force flag' AS model, CAST(2 AS INTEGER) AS n_terms, CAST(0 AS INTEGER) AS n_aliased,
               round(deviance + 4, 4) AS aic, round(deviance, 4) AS deviance,
               round((tp + tn) / n, 6) AS accuracy, round(((tp + tn) / n - e) / nullif(1 - e, 0), 6) AS kappa,
               round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, CAST(1 AS DOUBLE) AS max_vif
        FROM x, l"""),
)
def model_comparison_one_indicator(spark, sf_dir):
    spec = crossval.ModelSpec("in-force flag", _labelled(spark, sf_dir), ["inforce_ind"])
    table = crossval.compare_models([spec], "hhld_id", "future_clm_ind", k=10)
    return _rounded(
        _rounded(table, 4, "aic", "deviance"), 6, "accuracy", "kappa", "balanced_accuracy", "max_vif"
    )


@query("lasso_error_curve", "G13")
def lasso_error_curve(spark, sf_dir):
    table, names = _full(spark, sf_dir)
    path = lasso.lasso_path(table, "hhld_id", "future_clm_ind", names, mod.CATEGORICAL, k=10)
    return path.table(spark)


@query("lasso_deviance_curve", "G13 G4")
def lasso_deviance_curve(spark, sf_dir):
    """Held-out deviance per penalty over the whole modelling table, folds dealt by class."""
    table, names = _full(spark, sf_dir)
    path = deviance.deviance_path(
        table, "hhld_id", "future_clm_ind", names, mod.CATEGORICAL, n_lambda=30, smallest=1e-2, stratified=True, block=15
    )
    return path.table(spark)


@query("lasso_selected_features", "G14 G13")
def lasso_selected_features(spark, sf_dir):
    table, names = _full(spark, sf_dir)
    path = lasso.lasso_path(table, "hhld_id", "future_clm_ind", names, mod.CATEGORICAL, k=10)
    values = lasso.lasso_coefficients(
        table, "future_clm_ind", names, path.lambda_1se, mod.CATEGORICAL
    )
    return spark.createDataFrame(
        [(t, c, c != 0.0) for t, c in values.items()],
        "term string, estimate double, is_selected boolean",
    )


@query("model_ready_table_with_scores", "E12 M9")
def model_ready_table_with_scores(spark, sf_dir):
    """The exported table with scores and history, as the models read it."""
    return _full(spark, sf_dir)[0]


@query("model_sequence", "G17 G12 G15 G16")
def model_sequence(spark, sf_dir):
    return mod.model_sequence(
        v.predictors(spark, sf_dir),
        v.claims(spark, sf_dir),
        v.outcomes(spark, sf_dir),
        v.AS_OF,
        k=10,
    )


# ------------------------------------------------------------ categories of many levels


@query(
    "level_index_of_households",
    "G2",
    with_views("""
        SELECT hhld_id AS level, row_number() OVER (ORDER BY hhld_id) - 1 AS position, count(*) AS n
        FROM claims GROUP BY hhld_id"""),
)
def level_index_of_households(spark, sf_dir):
    return levels.index_levels(v.claims(spark, sf_dir), "hhld_id")


@query(
    "fault_by_household_levels",
    "G2 G3",
    with_views("""
        WITH t AS (SELECT hhld_id, count(*) AS n, sum(CASE WHEN aft_ind = 1 THEN 1 ELSE 0 END) AS n_yes
                   FROM claims WHERE aft_ind IS NOT NULL GROUP BY hhld_id),
        m AS (SELECT *, n_yes = 0 OR n_yes = n AS separated FROM t),
        base AS (SELECT n AS n0, n_yes AS y0, hhld_id AS first FROM m WHERE NOT separated ORDER BY hhld_id LIMIT 1),
        e AS (SELECT hhld_id, n, n_yes, separated, first,
                     CASE WHEN NOT separated THEN ln(n_yes / (n - n_yes)) - ln(y0 / (n0 - y0)) END AS estimate,
                     CASE WHEN NOT separated AND hhld_id <> first
                          THEN sqrt(1 / n_yes + 1 / (n - n_yes) + 1 / y0 + 1 / (n0 - y0)) END AS std_error
              FROM m, base)
        SELECT hhld_id AS level, n, CAST(n_yes AS BIGINT) AS n_yes, separated, round(estimate, 6) AS estimate,
               round(std_error, 6) AS std_error, round(estimate / std_error, 6) AS z_value FROM e"""),
)
def fault_by_household_levels(spark, sf_dir):
    rows = v.claims(spark, sf_dir).select(
        "hhld_id", F.when(F.col("aft_ind").isNotNull(), (F.col("aft_ind") == 1).cast("int")).alias("at_fault"))
    model = levels.fit_levels(rows, "at_fault", "hhld_id")
    base = model.effects.filter("not separated").agg(F.min("level")).first()[0]
    return _rounded(levels.level_table(model, base), 6, "estimate", "std_error", "z_value")
