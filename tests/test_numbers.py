"""Special functions, linear algebra models, trees and kernels against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.errors import InvalidInput
from tessella.functions import specfun as sf
from tessella.operators import bayes, cluster, compose, decomposition, explain, kernels, linear, preprocessing, search, selection, stats, trees


def test_special_functions():
    assert math.isclose(sf.normal_cdf(1.96), 0.9750021048517795, rel_tol=1e-12)
    assert math.isclose(sf.t_cdf(2.0, 10), 0.9633059826146299, rel_tol=1e-9)
    assert math.isclose(sf.chi2_cdf(3.841458820694124, 1), 0.95, rel_tol=1e-9)
    assert math.isclose(sf.f_cdf(4.0, 3, 12), 1 - 0.03464, abs_tol=2e-4)
    assert math.isclose(sf.t_quantile(0.975, 5), 2.570581835636314, rel_tol=1e-9)
    assert math.isclose(sf.chi2_quantile(0.95, 2), 5.991464547107979, rel_tol=1e-9)
    assert math.isclose(sf.normal_quantile(0.025), -1.959963984540054, rel_tol=1e-9)
    assert math.isclose(sf.betainc(2, 3, 0.4), 0.5248, rel_tol=1e-9) and math.isclose(sf.gammainc(3, 2), 1 - math.exp(-2) * 5, rel_tol=1e-9)
    assert sf.t_two_sided(math.inf, 5) == 0.0 and stats.sample_size(0.5) == 63 and 0.79 < stats.achieved_power(63, 0.5) < 0.82


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3))
    y = 2 + x @ [1.5, -2.0, 0.0] + rng.normal(0, 0.5, 300)
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 2), int(x[i, 0] > 0) + int(x[i, 1] > 0)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k int, g int").cache(), x, y


COLUMNS = ["a", "b", "c"]


def test_least_squares(table):
    df, x, y = table
    a = np.column_stack((np.ones(300), x))
    beta, rss = np.linalg.lstsq(a, y, rcond=None)[:2]
    m = linear.LinearRegression().fit(df, COLUMNS, "y")
    assert np.allclose([m.intercept, *m.coefficients], beta) and math.isclose(m.rss, rss[0], rel_tol=1e-8)
    inverse = np.linalg.inv(a.T @ a)
    assert np.allclose(m.standard_errors, np.sqrt(np.diag(inverse) * rss[0] / 296))
    assert m.p_values[1] < 1e-10 and m.p_values[3] > 0.01 and m.f_p_value < 1e-10
    leverage = {r.id: r.leverage for r in m.diagnose(df, "y").collect()}
    assert np.allclose([leverage[i] for i in range(300)], np.einsum("ij,jk,ik->i", a, inverse, a))
    inside = m.predict_interval(df).filter("y between lower and upper").count()
    assert 270 <= inside <= 300
    with pytest.raises(InvalidInput):
        linear.LinearRegression().fit(df.withColumn("d", F.col("a") * 2), ["a", "d"], "y")
    with pytest.raises(InvalidInput):
        linear.LinearRegression().fit(df.limit(3), COLUMNS, "y")


def test_penalised(table):
    df, x, y = table
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(linear.Ridge(5.0).fit(df, COLUMNS, "y").coefficients, np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc))
    lasso = linear.Lasso(0.3, tol=1e-10).fit(df, COLUMNS, "y")
    b = np.array(lasso.coefficients)
    gradient = xc.T @ (yc - xc @ b) / 300
    assert all(abs(g) <= 0.3 + 1e-6 if v == 0 else math.isclose(g, 0.3 * np.sign(v), rel_tol=1e-4) for g, v in zip(gradient, b))
    path = linear.regularisation_path(df, COLUMNS, "y", n=10)
    assert not any(path[0][1]) and all(p >= q for (p, _), (q, _) in zip(path, path[1:]))
    cv = linear.PenalisedCV((0.1, 1000.0)).fit(df, COLUMNS, "y", ["id"])
    assert cv.alpha == 0.1


def test_logistic(table):
    df, x, y = table
    noisy = df.withColumn("t", F.when(F.col("id") % 10 == 0, 1 - F.col("k")).otherwise(F.col("k")))
    t = np.array([1 - k if i % 10 == 0 else k for i, k in enumerate((y > 2).astype(int))])
    m = linear.LogisticRegression().fit(noisy, COLUMNS, "t")
    a = np.column_stack((np.ones(300), x))
    mu = 1 / (1 + np.exp(-a @ [m.intercept, *m.coefficients]))
    assert np.abs(a.T @ (t - mu)).max() < 1e-5 and len(m.odds_ratios) == 4
    with pytest.raises(InvalidInput):
        linear.LogisticRegression().fit(df, COLUMNS, "g")


def test_robust_and_quantile(spark, table):
    df, x, y = table
    wild = df.withColumn("y", F.when(F.col("id") % 15 == 0, F.col("y") + 100).otherwise(F.col("y")))
    for kind in ("huber", "bisquare", "hampel", "andrews"):
        m = linear.RobustRegression(kind).fit(wild, COLUMNS, "y")
        assert abs(m.coefficients[0] - 1.5) < 0.15 and abs(m.coefficients[1] + 2) < 0.15
    m = linear.QuantileRegression(0.8).fit(df, COLUMNS, "y")
    assert 0.74 < m.predict(df).agg(F.avg((F.col("y") <= F.col("prediction")).cast("double"))).first()[0] < 0.86


def test_margins(table):
    df, _, _ = table
    for model in (linear.GradientLinear("log"), linear.GradientLinear("hinge"), linear.Perceptron(), linear.LinearSVC(), linear.PassiveAggressive()):
        assert search.accuracy(model.fit(df, COLUMNS, "k").predict(df), "k", "prediction") > 0.85
    m = linear.GradientLinear("squared", penalty="none", max_iter=200).fit(df, COLUMNS, "y")
    assert abs(m.coefficients[0] - 1.5) < 0.1
    assert search.accuracy(linear.RidgeClassifier().fit(df, COLUMNS, "g").predict(df), "g", "prediction") > 0.6


def test_isotonic(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (3.0, 4.0), (4.0, 2.0), (5.0, 6.0)], "x double, y double")
    m = linear.IsotonicRegression().fit(df, "x", "y")
    assert m.points == [(1.0, 1.0), (2.0, 2.75), (4.0, 2.75), (5.0, 6.0)]
    got = m.predict(spark.createDataFrame([(0.0,), (1.5,), (4.5,), (9.0,)], "x double")).collect()
    assert [r.prediction for r in got] == [1.0, 1.875, 4.375, 6.0]


def test_bayes_and_discriminants(table):
    df, x, _ = table
    whole = bayes.GaussianNB().fit(df, COLUMNS, "g")
    parts = bayes.GaussianNB()
    for i in range(3):
        parts.partial_fit(df.filter(F.col("id") % 3 == i), COLUMNS, "g")
    for c in whole.classes:
        assert np.allclose(np.concatenate([np.atleast_1d(v) for v in whole.moments[c]]), np.concatenate([np.atleast_1d(v) for v in parts.moments[c]]))
    p = whole.predict_proba(df).select(sum(F.col(f"probability_{c}") for c in whole.classes).alias("p")).agg(F.min("p"), F.max("p")).first()
    assert math.isclose(p[0], 1) and math.isclose(p[1], 1)
    for m in (whole, bayes.QDA().fit(df, COLUMNS, "g"), bayes.LDA().fit(df, COLUMNS, "g")):
        assert search.accuracy(m.predict(df), "g", "prediction") > 0.7


def test_decompositions(table):
    df, x, _ = table
    m = decomposition.PCA().fit(df, COLUMNS)
    assert np.allclose(m.explained_variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    back = m.inverse_transform(m.transform(df)).agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}_restored"))) for c in COLUMNS]).first()
    assert max(back) < 1e-9
    two = decomposition.PCA().partial_fit(df.filter("id < 100"), COLUMNS).partial_fit(df.filter("id >= 100"), COLUMNS)
    assert np.allclose(two.explained_variance, m.explained_variance)
    assert np.allclose(decomposition.TruncatedSVD(3).fit(df, COLUMNS).singular_values, np.linalg.svd(x)[1])
    assert decomposition.FactorAnalysis(1, "promax").fit(df, COLUMNS).loadings.shape == (3, 1)
    assert decomposition.tsne(df.limit(40), "id", COLUMNS, steps=20).count() == 40
    with pytest.raises(InvalidInput):
        decomposition.tsne(df, "id", COLUMNS, max_rows=10)


def test_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([(i, float(a), float(b), [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, a double, b double, vector array<double>")
    truth = [i // 30 for i in range(90)]

    def same(found):
        by = dict(found)
        return len({(truth[i], by[i]) for i in range(90)}) == 3 and len({by[i] for i in range(90)}) == 3

    assert same((r.id, r.prediction) for r in cluster.KMeans(3, n_init=3).fit(df, ["a", "b"]).predict(df).collect())
    assert same((r.id, r.cluster) for r in cluster.DBSCAN(1.0, 4).fit_predict(df).collect())
    for linkage in ("ward", "complete", "average", "single"):
        assert same((r.id, r.cluster) for r in cluster.agglomerative(df, ["a", "b"], 3, linkage).collect())
    assert same((r.id, r.cluster) for r in cluster.hdbscan(df, ["a", "b"], 10).collect())
    assert same((r.id, r.prediction) for r in cluster.GaussianMixture(3, seed=2).fit(df, ["a", "b"]).predict(df).collect())
    assert 0.1 < cluster.optimal_eps(df, 4) < 5
    assert cluster.elbow({1: 100.0, 2: 50.0, 3: 5.0, 4: 4.0, 5: 3.5}) == 3


def test_trees(table):
    df, x, y = table
    m = trees.DecisionTree(max_depth=1).fit(df, COLUMNS, "k")
    t = (y > 2).astype(int)
    best = (-1, None, None)
    for j in range(3):
        v = np.unique(x[:, j])
        for cut in (v[1:] + v[:-1]) / 2:
            left = x[:, j] <= cut
            gini = lambda s: 2 * s.sum() * (len(s) - s.sum()) / len(s)
            gain = gini(t) - gini(t[left]) - gini(t[~left])
            if gain > best[0] + 1e-9:
                best = gain, j, cut
    root = trees.DecisionTree(max_depth=1, max_bins=400).fit(df, COLUMNS, "k").trees[0]
    assert root.feature == COLUMNS[best[1]] and math.isclose(root.threshold, best[2]) and math.isclose(root.gain, best[0])
    assert m.trees[0].depth() == 1
    deep = trees.DecisionTree("regression", max_depth=5).fit(df, COLUMNS, "y")
    assert search.r2(deep.predict(df), "y", "prediction") > 0.85
    forest = trees.RandomForest("classification", 3, 5, max_depth=4).fit(df, COLUMNS, "k", "id")
    assert search.accuracy(forest.predict(df), "k", "prediction") > 0.85 and 0.6 < forest.out_of_bag(df, "k", "id") <= 1
    boost = trees.GradientBoosting("log", 8, 0.3, trees.Growth("newton", 2)).fit(df, COLUMNS, "k", "id")
    assert search.accuracy(boost.predict(df), "k", "prediction") > 0.85
    up = trees.GradientBoosting("squared", 3, growth=trees.Growth("newton", 3, monotone=(("a", 1),))).fit(df, ["a"], "y", "id")
    curve = [r.mean for r in explain.partial_dependence(up.predict, df.limit(5), "a", [-2.0, -1.0, 0.0, 1.0, 2.0]).orderBy("grid_value").collect()]
    assert curve == sorted(curve)
    gaps = df.withColumn("a", F.when(F.col("id") % 4 != 0, F.col("a")))
    assert trees.DecisionTree(max_depth=3).fit(gaps, COLUMNS, "k").predict(gaps).filter("prediction is null").count() == 0


def test_tree_shap_adds_up(table):
    df, _, _ = table
    m = trees.DecisionTree("regression", max_depth=3).fit(df, COLUMNS, "y")
    got = explain.tree_shap(m.trees, df, COLUMNS, "id").join(m.predict(df).select("id", "prediction"), "id")
    gap = got.select(F.abs(F.col("base") + sum(F.col(f"shap_{c}") for c in COLUMNS) - F.col("prediction")).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-9
    rng = np.random.default_rng(0)
    background = rng.normal(0, 1, (20, 3))
    base, phi = explain.kernel_shap(lambda a: a @ [1.0, 2.0, 3.0], background, np.array([1.0, 1.0, 1.0]))
    assert np.allclose(phi, (1 - background.mean(0)) * [1, 2, 3], atol=1e-3)


def test_composition(table):
    df, _, _ = table
    pipe = compose.make_pipeline(preprocessing.StandardScaler(), model=linear.Ridge(1.0)).fit(df, COLUMNS, "y")
    assert search.r2(pipe.predict(df), "y", "prediction") > 0.9
    stack = compose.Stacking([("p", linear.LinearRegression), ("q", lambda: linear.Ridge(10.0))], lambda: linear.Ridge(0.1), 3).fit(df, COLUMNS, "y", ["id"])
    assert search.r2(stack.predict(df), "y", "prediction") > 0.9
    weights = compose.caruana_selection(df.withColumns({"p": F.col("y") + 0.1, "q": F.lit(0.0)}), ["p", "q"], "y")
    assert weights == {"p": 1.0}
    scored = df.withColumn("s", F.col("y") - 2)
    for c in (compose.SigmoidCalibration(), compose.IsotonicCalibration(), compose.TemperatureScaling()):
        r = c.fit(scored, "s", "k").transform(scored).agg(F.min("calibrated"), F.max("calibrated"), F.corr("calibrated", "k")).first()
        assert 0 <= r[0] <= r[1] <= 1 and r[2] > 0.7


def test_searches(table):
    df, _, _ = table
    r = search.cross_val_score(linear.LinearRegression, df, COLUMNS, "y", ["id"], folds=3)
    assert r.mean > 0.9 and r.interval()[0] < r.mean and not r.failures
    study = search.Study({"u": search.Param(0.0, 1.0), "n": search.Param(1, 9, "int"), "c": search.Param(choices=("p", "q"))}, False, search.TPESampler(startup=5))
    best = study.optimise(lambda p: (p["u"] - 0.3) ** 2 + abs(p["n"] - 4) / 10 + (p["c"] == "q"), 40)
    assert best.value < 0.5 and abs(sum(study.importance().values()) - 1) < 1e-9
    bayes_study = search.Study({"u": search.Param(0.0, 1.0)}, True, search.BayesSampler())
    assert bayes_study.optimise(lambda p: -((p["u"] - 0.7) ** 2), 15).value > -0.01
    assert len(list(search.grid_points({"a": search.Param(0, 1), "b": search.Param(choices=(1, 2))}, 3))) == 6
    assert search.hyperband({"u": search.Param(0.0, 1.0)}, lambda p, r: p["u"] * r, 9).best.value > 0
    pruner = search.MedianPruner(2)
    s = search.Study({"u": search.Param()})
    s.trials = [search.Trial({}, 1.0, "complete", [1.0, 2.0]), search.Trial({}, 1.0, "complete", [3.0, 4.0])]
    slow = search.Trial({}, None, "running", [0.5])
    assert pruner.should_prune(s, slow)
    left, rank = selection.recursive_elimination(lambda cs: {c: abs(v) for c, v in zip(cs, linear.Ridge(1.0).fit(df, cs, "y").coefficients)}, COLUMNS, 2)
    assert left == ["a", "b"] and rank["c"] == 2
    assert selection.select_from_importances({"a": 3.0, "b": 1.0, "c": 2.0}, "median") == ["a", "c"]


def test_kernels(table):
    df, _, _ = table
    part = df.filter("id < 120")
    assert search.r2(kernels.GaussianProcessRegressor(kernels.Kernel("rbf", 2.0) + kernels.Kernel("constant"), 0.1).fit(part, COLUMNS, "y").predict(part), "y", "prediction") > 0.9
    assert search.accuracy(kernels.SVC().fit(part, COLUMNS, "k").predict(part), "k", "prediction") > 0.9
    assert search.r2(kernels.SVR(10.0, 0.1, kernels.Kernel("rbf", 2.0)).fit(part, COLUMNS, "y").predict(part), "y", "prediction") > 0.8
    assert search.accuracy(kernels.MLP((16,), epochs=60).fit(df, COLUMNS, "k").predict(df), "k", "prediction") > 0.9
    assert kernels.GaussianProcessClassifier(kernels.Kernel("matern", 2.0)).fit(part, COLUMNS, "k").predict_proba(part).filter("(probability > 0.5) = (k = 1)").count() > 100
    assert search.r2(kernels.SparseGPRegressor(kernels.Kernel("rbf", 2.0), n_inducing=20).fit(df, COLUMNS, "y").predict(df), "y", "prediction") > 0.8
    with pytest.raises(InvalidInput):
        kernels.SVC(max_rows=10).fit(df, COLUMNS, "k")


def test_statistics(table):
    df, x, y = table
    t = stats.t_test(df, "y", "k", 1, 0)
    assert t.p_value < 1e-10 and t.interval[0] < y[y > 2].mean() - y[y <= 2].mean() < t.interval[1]
    c = stats.correlation(df, "a", "y")
    assert math.isclose(c.effect, np.corrcoef(x[:, 0], y)[0, 1], rel_tol=1e-9) and c.interval[0] < c.effect < c.interval[1]
    low, high = stats.confidence_interval(df, "y")
    assert low < y.mean() < high
    se, a, b = stats.bootstrap_interval(df, "y", "id", 200)
    assert a < y.mean() < b and abs(se - y.std() / math.sqrt(300)) < 0.05
    assert stats.paired_t(df, "a", "b").p_value > 0.001 and stats.five_by_two_t([(0.1, 0.2)] * 5).df == 5
    assert stats.mann_whitney_test(df, "y", "k", 1, 0).p_value < 1e-10 and stats.wilcoxon_test(df, "a", "b").p_value > 0.001
    assert stats.normality(df, "a").p_value > 0.001 and 1.5 < stats.diagnose_residuals(df, "a", ["id"])["durbin_watson"] < 2.5


def test_power_transform_inverts(table):
    df, _, _ = table
    m = preprocessing.PowerTransformer().fit(df, ["a", "y"])
    gap = m.inverse_transform(m.transform(df)).alias("p").join(df.alias("q"), "id").agg(F.max(F.abs(F.col("p.a") - F.col("q.a"))), F.max(F.abs(F.col("p.y") - F.col("q.y")))).first()
    assert max(gap) < 1e-6
    r = m.transform(df).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9
    for scaler in (preprocessing.StandardScaler(), preprocessing.MinMaxScaler(-1, 1), preprocessing.RobustScaler(), preprocessing.MaxAbsScaler()):
        back = scaler.inverse_transform(scaler.fit_transform(df, ["a"])).alias("p").join(df.alias("q"), "id").agg(F.max(F.abs(F.col("p.a") - F.col("q.a")))).first()[0]
        assert back < 1e-9
    random.seed(0)


def test_edges(spark):
    flat = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 1.0), (3, 5.0, float("nan"))], "id long, a double, b double")
    assert [r.a for r in preprocessing.StandardScaler().fit_transform(flat, ["a"]).collect()] == [0.0, 0.0, 0.0]
    assert [r.a for r in preprocessing.MinMaxScaler(2, 3).fit_transform(flat, ["a"]).collect()] == [2.0, 2.0, 2.0]
    assert [r.b for r in preprocessing.SimpleImputer("mean").fit_transform(flat, ["b"]).collect()] == [1.0, 1.0, 1.0]
    with pytest.raises(InvalidInput):
        preprocessing.VarianceThreshold().fit(flat, ["a"])
    with pytest.raises(Exception, match="unknown category"):
        preprocessing.OneHotEncoder().fit(flat, ["id"]).transform(flat.withColumn("id", F.lit(9).cast("long"))).collect()
