"""Queries over models: fits, predictions, explanations, searches, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import bayes as B
from tessella.operators import cluster as C
from tessella.operators import compose as E
from tessella.operators import decomposition as D
from tessella.operators import explain as X
from tessella.operators import kernels as G
from tessella.operators import linear as L
from tessella.operators import preprocessing as P
from tessella.operators import search as H
from tessella.operators import trees as R
from tessella.operators.text import CountVectorizer
from tessella.plans.registry import register, rounded, table
from tessella.sources import files
from tessella.streaming.moments import drift, merge_moments, moments, windowed_counts

XS = ["l_quantity", "l_discount", "l_tax"]


def _line(spark, d):
    return table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("big", (F.col("l_extendedprice") > 40000).cast("int"))


def _row(spark, **values):
    return spark.createDataFrame([tuple(map(float, values.values()))], ", ".join(f"`{k}` double" for k in values))


@register("ols_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def ols_simple(spark, d):
    m = L.LinearRegression().fit(_line(spark, d), ["l_quantity"], "l_extendedprice")
    return rounded(rounded(rounded(_row(spark, slope=m.coefficients[0], intercept=m.intercept, r2=m.r2), ["slope"]), ["intercept"], 4), ["r2"], 8)


_TWO = "s AS (SELECT count(*)::DOUBLE AS n, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_tax, l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS by_, avg(l_quantity) AS ma, avg(l_tax) AS mb, avg(l_extendedprice) AS my FROM lineitem)"


@register("ols_two_feature", f"WITH {_TWO}, b AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s) SELECT round(p, 4) AS quantity, round(q, 2) AS tax, round(my - p * ma - q * mb, 3) AS intercept FROM b")
def ols_two_feature(spark, d):
    m = L.LinearRegression().fit(_line(spark, d), ["l_quantity", "l_tax"], "l_extendedprice")
    return rounded(rounded(rounded(_row(spark, quantity=m.coefficients[0], tax=m.coefficients[1], intercept=m.intercept), ["quantity"], 4), ["tax"], 2), ["intercept"], 3)


@register("ridge_simple", "SELECT round(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1000), 6) AS slope FROM lineitem")
def ridge_simple(spark, d):
    m = L.Ridge(1000.0).fit(_line(spark, d), ["l_quantity"], "l_extendedprice")
    return rounded(_row(spark, slope=m.coefficients[0]), ["slope"])


@register("lasso_simple", "SELECT round(sign(covar_pop(l_extendedprice, l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity)) - 50, 0) / var_pop(l_quantity), 5) AS slope FROM lineitem")
def lasso_simple(spark, d):
    m = L.Lasso(50.0).fit(_line(spark, d), ["l_quantity"], "l_extendedprice")
    return rounded(_row(spark, slope=m.coefficients[0]), ["slope"], 5)


@register("ols_diagnostics")
def ols_diagnostics(spark, d):
    df = _line(spark, d)
    m = L.LinearRegression().fit(df, XS, "l_extendedprice")
    return rounded(m.diagnose(df, "l_extendedprice").agg(F.sum("leverage").alias("leverage"), F.count_if("influential").alias("influential"), F.max("cooks_distance").alias("cooks")), ["leverage", "cooks"])


@register("regularisation_path")
def regularisation_path(spark, d):
    path = L.regularisation_path(_line(spark, d), XS, "l_extendedprice", n=20)
    return rounded(spark.createDataFrame([(float(a), *map(float, b)) for a, b in path], "alpha double, " + ", ".join(f"{c} double" for c in XS)), ["alpha", *XS], 3)


@register("penalised_cv")
def penalised_cv(spark, d):
    df = _line(spark, d)
    ridge = L.PenalisedCV((0.1, 1.0, 10.0)).fit(df, XS, "l_extendedprice", ["id"])
    lasso = L.PenalisedCV(l1_ratios=(0.5, 1.0), n_alphas=10).fit(df, XS, "l_extendedprice", ["id"])
    return rounded(_row(spark, ridge_alpha=ridge.alpha, lasso_alpha=lasso.alpha, l1_ratio=lasso.l1_ratio), ["lasso_alpha"], 4)


def _scored(df, model, target):
    return model.predict(df).agg(F.avg((F.col(target) == F.col("prediction")).cast("double")).alias("accuracy"))


@register("ridge_classifier")
def ridge_classifier(spark, d):
    df = _line(spark, d)
    return rounded(_scored(df, L.RidgeClassifier().fit(df, XS, "l_returnflag"), "l_returnflag"), ["accuracy"])


@register("logistic_regression")
def logistic_regression(spark, d):
    df = _line(spark, d)
    m = L.LogisticRegression().fit(df, ["l_quantity", "l_tax"], "big")
    return rounded(_row(spark, intercept=m.intercept, quantity=m.coefficients[0], tax=m.coefficients[1]), ["intercept", "quantity", "tax"], 4)


for _name in ("huber", "bisquare", "hampel", "andrews"):

    @register(f"robust_{_name}")
    def robust(spark, d, kind=_name):
        m = L.RobustRegression(kind, max_iter=10).fit(_line(spark, d), ["l_quantity"], "l_extendedprice")
        return rounded(_row(spark, slope=m.coefficients[0], intercept=m.intercept, scale=m.scale), ["slope", "intercept", "scale"], 2)


@register("quantile_regression")
def quantile_regression(spark, d):
    m = L.QuantileRegression(0.9, max_iter=20).fit(_line(spark, d), ["l_quantity"], "l_extendedprice")
    return rounded(_row(spark, slope=m.coefficients[0], intercept=m.intercept), ["slope", "intercept"], 0)


for _name, _make in {"sgd_hinge": lambda: L.GradientLinear("hinge", max_iter=40), "perceptron": lambda: L.Perceptron(max_iter=40), "passive_aggressive": lambda: L.PassiveAggressive(max_iter=40), "linear_svc": lambda: L.LinearSVC(max_iter=40)}.items():

    @register(_name)
    def margin(spark, d, make=_make):
        df = _line(spark, d)
        return rounded(_scored(df, make().fit(df, ["l_quantity", "l_tax"], "big"), "big"), ["accuracy"], 3)


@register("linear_svr")
def linear_svr(spark, d):
    df = _line(spark, d).withColumn("y", F.col("l_extendedprice") / 1000)
    m = L.LinearSVR(max_iter=60).fit(df, ["l_quantity"], "y")
    return rounded(_row(spark, slope=m.coefficients[0]), ["slope"], 2)


@register("isotonic_regression")
def isotonic_regression(spark, d):
    m = L.IsotonicRegression().fit(_line(spark, d), "l_quantity", "l_extendedprice")
    return rounded(spark.createDataFrame(m.points, "x double, y double"), ["y"], 3)


@register("gaussian_nb_fit", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 5) AS var, round(count(*) / sum(count(*)) OVER (), 8) AS prior FROM lineitem GROUP BY 1")
def gaussian_nb_fit(spark, d):
    m = B.GaussianNB().fit(_line(spark, d), ["l_quantity"], "l_returnflag")
    total = sum(v[0] for v in m.moments.values())
    df = spark.createDataFrame([(c, float(mean[0]), float(var[0]), n / total) for c, (n, mean, var) in m.moments.items()], "l_returnflag string, mean double, var double, prior double")
    return rounded(rounded(rounded(df, ["mean"]), ["var"], 5), ["prior"], 8)


@register(
    "gaussian_nb_predict",
    """WITH x AS (SELECT o_orderkey, o_orderstatus AS y, o_totalprice AS v, o_custkey::DOUBLE AS w FROM orders), m AS (SELECT y, ln(count(*)::DOUBLE / (SELECT count(*) FROM x)) AS p, avg(v) AS a, var_pop(v) AS s, avg(w) AS b, var_pop(w) AS t FROM x GROUP BY y),
    e AS (SELECT 1e-9 * max(greatest(s, t)) AS e FROM m), l AS (SELECT o_orderkey, m.y, p - 0.5 * (ln(2 * pi() * (s + e)) + ln(2 * pi() * (t + e)) + (v - a) ** 2 / (s + e) + (w - b) ** 2 / (t + e)) AS l FROM x, m, e)
    SELECT o_orderkey, arg_max(y, l) AS prediction FROM l GROUP BY o_orderkey""",
)
def gaussian_nb_predict(spark, d):
    df = table(spark, d, "orders")
    return B.GaussianNB().fit(df, ["o_totalprice", "o_custkey"], "o_orderstatus").predict(df).select("o_orderkey", "prediction")


_TOKENS = r"""t AS (SELECT doc_id AS doc, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda z: strlen(z) >= 2)) AS term FROM documents),
c AS (SELECT doc, term, count(*) AS n FROM t GROUP BY ALL), y AS (SELECT doc_id AS doc, lang AS class FROM documents), v AS (SELECT DISTINCT term FROM c), k AS (SELECT class, count(*) AS d FROM y GROUP BY class)"""


def _terms(spark, d):
    docs = table(spark, d, "documents")
    return CountVectorizer().counts(docs), docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("y"))


@register("multinomial_nb_fit", f"WITH {_TOKENS}, s AS (SELECT class, term, sum(n)::DOUBLE AS c FROM c JOIN y USING (doc) GROUP BY ALL), g AS (SELECT k.class, v.term, coalesce(s.c, 0) AS c FROM k CROSS JOIN v LEFT JOIN s ON s.class = k.class AND s.term = v.term) SELECT class, term, c, round(ln((c + 1) / (sum(c) OVER (PARTITION BY class) + count(*) OVER (PARTITION BY class))), 6) AS log_p FROM g")
def multinomial_nb_fit(spark, d):
    return rounded(B.TermNB().fit(*_terms(spark, d)).terms, ["log_p"])


@register("bernoulli_nb_fit", f"WITH {_TOKENS}, s AS (SELECT class, term, count(*)::DOUBLE AS c FROM c JOIN y USING (doc) GROUP BY ALL), g AS (SELECT k.class, v.term, d, coalesce(s.c, 0) AS c FROM k CROSS JOIN v LEFT JOIN s ON s.class = k.class AND s.term = v.term) SELECT class, term, c, round(ln((c + 1) / (d + 2)), 6) AS log_p, round(ln(1 - (c + 1) / (d + 2)), 6) AS log_q FROM g")
def bernoulli_nb_fit(spark, d):
    return rounded(B.TermNB("bernoulli").fit(*_terms(spark, d)).terms, ["log_p", "log_q"])


@register("multinomial_nb_predict")
def multinomial_nb_predict(spark, d):
    terms, labels = _terms(spark, d)
    return B.TermNB().fit(terms, labels).predict(terms)


@register(
    "categorical_nb_fit",
    """WITH s AS (SELECT o_orderstatus AS class, 'o_orderpriority' AS feature, o_orderpriority AS category, count(*) AS c FROM orders GROUP BY ALL), n AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1),
    v AS (SELECT DISTINCT o_orderpriority AS category FROM orders) SELECT n.class, 'o_orderpriority' AS feature, v.category, coalesce(c, 0) AS c, round(ln((coalesce(c, 0) + 1.0::DOUBLE) / (n + (SELECT count(*) FROM v))), 6) AS log_p FROM n CROSS JOIN v LEFT JOIN s ON s.class = n.class AND s.category = v.category""",
)
def categorical_nb_fit(spark, d):
    return rounded(B.CategoricalNB().fit(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus").table, ["log_p"])


@register("qda_predict")
def qda_predict(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("c"), "o_orderstatus")
    return B.QDA().fit(df, ["o_totalprice", "c"], "o_orderstatus").predict(df).groupBy("prediction").count()


@register("lda_transform")
def lda_transform(spark, d):
    df = _line(spark, d)
    m = B.LDA().fit(df, XS, "l_returnflag")
    return rounded(m.transform(df).groupBy("l_returnflag").agg(*[F.avg(F.abs(f"ld{k}")).alias(f"ld{k}") for k in range(m.scalings.shape[1])]), ["ld0", "ld1"], 4)


def _flat(spark, d, n=64):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)])


@register("pca_two_columns", "WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS b, covar_samp(l_quantity, l_discount * 100) AS c FROM lineitem) SELECT round((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c), 6) AS first, round((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c), 6) AS second FROM c")
def pca_two_columns(spark, d):
    m = D.PCA().fit(_line(spark, d).withColumn("e", F.col("l_discount") * 100), ["l_quantity", "e"])
    return rounded(_row(spark, first=m.explained_variance[0], second=m.explained_variance[1]), ["first", "second"])


@register("pca_embeddings")
def pca_embeddings(spark, d):
    df, xs = _flat(spark, d), [f"x{i}" for i in range(64)]
    return rounded(D.PCA(3).fit(df, xs).transform(df).select("id", *[F.abs(f"pc{k}").alias(f"pc{k}") for k in range(3)]), ["pc0", "pc1", "pc2"], 4)


@register("truncated_svd")
def truncated_svd(spark, d):
    m = D.TruncatedSVD(3).fit(_flat(spark, d), [f"x{i}" for i in range(64)])
    return rounded(spark.createDataFrame([(i, float(s)) for i, s in enumerate(m.singular_values)], "k int, s double"), ["s"], 5)


@register("factor_analysis")
def factor_analysis(spark, d):
    m = D.FactorAnalysis(2, "varimax").fit(_flat(spark, d), [f"x{i}" for i in range(64)])
    return rounded(spark.createDataFrame([(c, float(v)) for c, v in zip(m.columns, m.noise)], "feature string, noise double"), ["noise"], 3)


@register("tsne_nations", "SELECT n_nationkey::BIGINT AS id FROM nation")
def tsne_nations(spark, d):
    df = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("double").alias("x0"), F.col("n_regionkey").cast("double").alias("x1"))
    return D.tsne(df, "id", ["x0", "x1"], perplexity=5.0).select("id")


_START = [[5.0, 0.01], [25.0, 0.05], [45.0, 0.09]]


@register("kmeans_one_round", "WITH s AS (SELECT l_quantity, (l_quantity - 5) ** 2 + (l_discount - 0.01) ** 2 AS a, (l_quantity - 25) ** 2 + (l_discount - 0.05) ** 2 AS b, (l_quantity - 45) ** 2 + (l_discount - 0.09) ** 2 AS c FROM lineitem) SELECT CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS k, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM s GROUP BY 1")
def kmeans_one_round(spark, d):
    k = C.assign(["l_quantity", "l_discount"], _START)
    return rounded(_line(spark, d).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")), ["mean"])


@register("kmeans")
def kmeans(spark, d):
    m = C.KMeans(3).fit(_line(spark, d), ["l_quantity", "l_discount"], "id", _START)
    return rounded(spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(m.centres)], "k int, a double, b double"), ["a", "b"], 4)


@register("minibatch_kmeans")
def minibatch_kmeans(spark, d):
    df, m = _line(spark, d), C.KMeans(3)
    for part in range(3):
        m.partial_fit(df.filter(F.col("l_orderkey") % 3 == part), ["l_quantity", "l_discount"], "id")
    return spark.createDataFrame([(k, n) for k, n in m.counts.items()], "k int, n long")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_CORE = "v AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT a.i, b.i AS j FROM v a, v b WHERE list_distance(a.v, b.v) <= 1.25), c AS (SELECT i, count(*) AS n FROM l GROUP BY i HAVING count(*) >= 5)"


@register("dbscan_core_points", f"WITH {_CORE} SELECT i AS id, n FROM c")
def dbscan_core_points(spark, d):
    return C.DBSCAN(1.25, 5).core_points(_vectors(spark, d))


@register(
    "dbscan_clusters",
    f"""WITH RECURSIVE {_CORE}, e AS (SELECT l.i, l.j FROM l JOIN c a ON a.i = l.i JOIN c b ON b.i = l.j), r(i, root) AS (SELECT i, i FROM c UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.i WHERE r.root < e.j),
    m AS (SELECT i, min(root) AS root FROM r GROUP BY i), k AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS k FROM m)
    SELECT v.i AS id, coalesce(any_value(o.k), min(k.k), -1)::INT AS cluster FROM v LEFT JOIN k o ON o.i = v.i LEFT JOIN l ON l.i = v.i LEFT JOIN k ON k.i = l.j GROUP BY v.i""",
)
def dbscan_clusters(spark, d):
    return C.DBSCAN(1.25, 5).fit_predict(_vectors(spark, d))


for _name in ("ward", "complete", "average", "single"):

    @register(f"agglomerative_{_name}")
    def agglomerative(spark, d, linkage=_name):
        df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("n"))
        return C.agglomerative(df, ["a", "n"], 5, linkage)


@register("hdbscan")
def hdbscan(spark, d):
    return C.hdbscan(_flat(spark, d), [f"x{i}" for i in range(64)], 10)


@register("gaussian_mixture")
def gaussian_mixture(spark, d):
    df = _line(spark, d)
    return C.GaussianMixture(2, "diag", max_iter=5).fit(df, ["l_quantity", "l_discount"], "id").predict(df).groupBy("prediction").count()


@register("bin_mapper", "WITH u AS (SELECT DISTINCT l_discount AS v FROM lineitem), p AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS cut FROM u) SELECT round(cut, 6) AS cut FROM p WHERE cut IS NOT NULL")
def bin_mapper(spark, d):
    m = R.BinMapper().fit(table(spark, d, "lineitem"), ["l_discount"])
    return rounded(spark.createDataFrame([(float(c),) for c in m.cuts["l_discount"]], "cut double"), ["cut"])


@register(
    "gini_best_split",
    """WITH g AS (SELECT l_discount AS v, count(*)::DOUBLE AS n, count(*) FILTER (l_extendedprice > 40000)::DOUBLE AS p FROM lineitem GROUP BY 1), c AS (SELECT v, lead(v) OVER (ORDER BY v) AS w, sum(n) OVER (ORDER BY v) AS a, sum(p) OVER (ORDER BY v) AS b, sum(n) OVER () AS t, sum(p) OVER () AS s FROM g),
    f AS (SELECT (v + w) / 2 AS threshold, 2 * s * (t - s) / t - 2 * b * (a - b) / a - 2 * (s - b) * (t - a - s + b) / (t - a) AS gain FROM c WHERE w IS NOT NULL) SELECT round(threshold, 6) AS threshold, round(gain, 4) AS gain FROM f ORDER BY gain DESC LIMIT 1""",
)
def gini_best_split(spark, d):
    t = R.DecisionTree(max_depth=1).fit(_line(spark, d), ["l_discount"], "big").trees[0]
    return rounded(rounded(_row(spark, threshold=t.threshold, gain=t.gain), ["threshold"]), ["gain"], 4)


@register("decision_tree")
def decision_tree(spark, d):
    df = _line(spark, d)
    return rounded(_scored(df, R.DecisionTree(max_depth=4).fit(df, XS, "big"), "big"), ["accuracy"])


@register("decision_tree_regression")
def decision_tree_regression(spark, d):
    df = _line(spark, d)
    m = R.DecisionTree("regression", max_depth=3).fit(df, XS, "l_extendedprice")
    return rounded(m.predict(df).groupBy("prediction").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean")), ["prediction", "mean"], 3)


@register("random_forest")
def random_forest(spark, d):
    df = _line(spark, d)
    return rounded(_scored(df, R.RandomForest("classification", 3, 5, max_depth=4).fit(df, XS, "big", "id"), "big"), ["accuracy"], 3)


@register("extra_trees")
def extra_trees(spark, d):
    df = _line(spark, d)
    return rounded(_scored(df, R.ExtraTrees("classification", 3, 5, max_depth=4).fit(df, XS, "big", "id"), "big"), ["accuracy"], 3)


@register("hist_boosting_regression")
def hist_boosting_regression(spark, d):
    df = _line(spark, d)
    m = R.GradientBoosting(n_rounds=5, rate=0.3, growth=R.Growth("newton", 3, min_leaf=20)).fit(df, XS, "l_extendedprice", "id")
    return rounded(m.predict(df).agg(F.corr("prediction", "l_extendedprice").alias("r")), ["r"], 4)


@register("hist_boosting_classes")
def hist_boosting_classes(spark, d):
    df = _line(spark, d)
    m = R.GradientBoosting("multiclass", 2, growth=R.Growth("newton", 2, min_leaf=20)).fit(df, XS, "l_returnflag", "id")
    return m.predict(df).groupBy("prediction").count()


@register("adaboost_classifier")
def adaboost_classifier(spark, d):
    df = _line(spark, d)
    return rounded(_scored(df, R.AdaBoostClassifier(3).fit(df, XS, "big"), "big"), ["accuracy"], 4)


@register("adaboost_regressor")
def adaboost_regressor(spark, d):
    df = _line(spark, d)
    return rounded(R.AdaBoostRegressor(3).fit(df, XS, "l_extendedprice").predict(df).agg(F.corr("prediction", "l_extendedprice").alias("r")), ["r"], 4)


@register("ordered_target_encoding", "SELECT o_orderkey, round((coalesce(sum(o_totalprice) OVER w, 0) + (SELECT avg(o_totalprice) FROM orders)) / (count(*) OVER w + 1), 3) AS e FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def ordered_target_encoding(spark, d):
    df = R.ordered_target_encoding(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", ["o_orderkey"])
    return rounded(df.select("o_orderkey", F.col("o_orderpriority_encoded").alias("e")), ["e"], 3)


@register("pipeline_scaled_ridge", "SELECT round(covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) * count(*) / (count(*) + 10.0), 5) AS slope FROM lineitem")
def pipeline_scaled_ridge(spark, d):
    m = E.make_pipeline(P.StandardScaler(), model=L.Ridge(10.0)).fit(_line(spark, d), ["l_quantity"], "l_extendedprice")
    return rounded(_row(spark, slope=m.model.coefficients[0]), ["slope"], 5)


@register("column_transformer", "WITH a AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem) SELECT round((l_quantity - m) / s, 6) AS s__l_quantity, round((l_tax - lo) / (hi - lo), 6) AS m__l_tax, l_orderkey, l_linenumber FROM lineitem, a")
def column_transformer(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(E.ColumnTransformer([("s", P.StandardScaler(), ["l_quantity"]), ("m", P.MinMaxScaler(), ["l_tax"])], "passthrough").fit(df).transform(df), ["s__l_quantity", "m__l_tax"])


@register("feature_union", "WITH a AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, round((l_quantity - m) / s, 6) AS s__l_quantity, round(2 * (l_quantity - lo) / (hi - lo), 6) AS m__l_quantity FROM lineitem, a")
def feature_union(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(E.FeatureUnion([("s", P.StandardScaler()), ("m", P.MinMaxScaler())], {"m": 2.0}).fit(df, ["l_quantity"]).transform(df), ["s__l_quantity", "m__l_quantity"])


@register("voting_hard", "SELECT doc_id, CASE WHEN quality + toxic + doc_id % 2 >= 2 THEN 1 ELSE 0 END AS prediction FROM labels")
def voting_hard(spark, d):
    df = table(spark, d, "labels").withColumn("odd", F.col("doc_id") % 2)
    return E.vote_hard(df, ["quality", "toxic", "odd"], [0, 1]).select("doc_id", "prediction")


@register("voting_soft", "SELECT o_orderkey, CASE WHEN (p + 2 * q) >= 1.5 THEN 0 ELSE 1 END AS prediction FROM (SELECT o_orderkey, (o_orderkey % 10) / 10 AS p, (o_orderkey % 7) / 7 AS q FROM orders)")
def voting_soft(spark, d):
    p, q = (F.col("o_orderkey") % 10) / 10, (F.col("o_orderkey") % 7) / 7
    df = table(spark, d, "orders").select("o_orderkey", p.alias("a0"), (1 - p).alias("a1"), q.alias("b0"), (1 - q).alias("b1"))
    return E.vote_soft(df, [["a0", "a1"], ["b0", "b1"]], [0, 1], [1.0, 2.0]).select("o_orderkey", "prediction")


@register("bagging")
def bagging(spark, d):
    df = _line(spark, d)
    m = E.Bagging(L.LinearRegression, 3).fit(df, ["l_quantity"], "l_extendedprice", "id")
    return rounded(m.predict(df).agg(F.corr("prediction", "l_extendedprice").alias("r")), ["r"])


@register("stacking")
def stacking(spark, d):
    df = _line(spark, d)
    m = E.Stacking([("a", L.LinearRegression), ("b", lambda: L.Ridge(100.0))], lambda: L.Ridge(1.0), 3).fit(df, ["l_quantity", "l_tax"], "l_extendedprice", ["id"])
    return rounded(m.predict(df).agg(F.corr("prediction", "l_extendedprice").alias("r")), ["r"])


def _scores(spark, d):
    return table(spark, d, "labels").select("doc_id", "toxic", ((F.col("doc_id") % 17) / 4.0 - 2 + 2.0 * F.col("toxic")).alias("s"))


@register("calibrate_sigmoid")
def calibrate_sigmoid(spark, d):
    m = E.SigmoidCalibration().fit(_scores(spark, d), "s", "toxic")
    return rounded(_row(spark, a=m.a, b=m.b), ["a", "b"], 4)


@register("calibrate_isotonic")
def calibrate_isotonic(spark, d):
    df = _scores(spark, d)
    return rounded(E.IsotonicCalibration().fit(df, "s", "toxic").transform(df).select("doc_id", "calibrated"), ["calibrated"])


@register("calibrate_temperature")
def calibrate_temperature(spark, d):
    return rounded(_row(spark, t=E.TemperatureScaling().fit(_scores(spark, d), "s", "toxic").temperature), ["t"], 4)


@register("calibrated_cv")
def calibrated_cv(spark, d):
    df = _line(spark, d)
    m = E.CalibratedCV(folds=2).fit(df, ["l_quantity"], "big", ["id"])
    return rounded(m.predict_proba(df).agg(F.avg("probability").alias("p")), ["p"], 3)


@register("ensemble_selection")
def ensemble_selection(spark, d):
    df = _line(spark, d).withColumns({"a": F.col("l_quantity") * 1500, "b": F.col("l_quantity") * 1000 + 9000, "c": F.lit(38000.0)})
    return spark.createDataFrame(list(E.caruana_selection(df, ["a", "b", "c"], "l_extendedprice", 5).items()), "model string, weight double")


@register(
    "pdp_linear",
    "WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem), g AS (SELECT unnest([1.0, 10.0, 25.0, 50.0])::DOUBLE AS grid_value) SELECT grid_value, round(i + s * grid_value, 4) AS mean FROM b, g",
)
def pdp_linear(spark, d):
    df = _line(spark, d)
    m = L.LinearRegression().fit(df, ["l_quantity"], "l_extendedprice")
    return rounded(X.partial_dependence(m.predict, df, "l_quantity", [1.0, 10.0, 25.0, 50.0]).select("grid_value", "mean"), ["mean"], 4)


@register("ice_linear", "WITH b AS (SELECT regr_slope(o_totalprice, o_custkey) AS s FROM orders), g AS (SELECT unnest([0.0, 100.0])::DOUBLE AS grid_value) SELECT o_orderkey, grid_value, round(s * grid_value, 5) + 0.0 AS centred FROM orders, b, g")
def ice_linear(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("c"), "o_totalprice")
    m = L.LinearRegression().fit(df, ["c"], "o_totalprice")
    return rounded(X.centred_ice(m.predict, df, "c", [0.0, 100.0], "o_orderkey").select("o_orderkey", "grid_value", "centred"), ["centred"], 5)


@register("permutation_importance")
def permutation_importance(spark, d):
    df = _line(spark, d).select("id", "l_quantity", "l_tax", "l_extendedprice")
    m = L.LinearRegression().fit(df, ["l_quantity", "l_tax"], "l_extendedprice")
    found = X.permutation_importance(m.predict, df, ["l_quantity", "l_tax"], "l_extendedprice", H.r2, "id", 2)
    return rounded(spark.createDataFrame([(c, *v) for c, v in found.items()], "feature string, mean double, std double, low double, high double"), ["mean", "std", "low", "high"], 4)


@register("h_statistic")
def h_statistic(spark, d):
    df = _line(spark, d)
    predict = lambda x: x.withColumn("prediction", F.col("l_quantity") * F.col("l_tax") + F.col("l_discount"))
    return rounded(spark.createDataFrame([("tax", X.h_statistic(predict, df, "l_quantity", "l_tax", 5)), ("discount", X.h_statistic(predict, df, "l_quantity", "l_discount", 5))], "other string, h double"), ["h"], 4)


@register("tree_shap")
def tree_shap(spark, d):
    df = _line(spark, d)
    m = R.DecisionTree("regression", max_depth=3).fit(df, XS, "l_extendedprice")
    return rounded(X.shap_summary(X.tree_shap(m.trees, df, XS, "id"), XS), ["mean_abs", "mean", "std"], 3)


@register("cross_validation")
def cross_validation(spark, d):
    r = H.cross_val_score(L.LinearRegression, _line(spark, d), ["l_quantity"], "l_extendedprice", ["id"], folds=3)
    return rounded(spark.createDataFrame(list(enumerate(r.scores)), "fold int, r2 double"), ["r2"])


@register("grid_search")
def grid_search(spark, d):
    _, found = H.grid_search(L.Ridge, {"alpha": [1.0, 1e6]}, _line(spark, d), ["l_quantity"], "l_extendedprice", ["id"], folds=2)
    return rounded(spark.createDataFrame([(dict(k)["alpha"], r.mean) for k, r in found.items()], "alpha double, r2 double"), ["r2"])


@register("automl")
def automl(spark, d):
    portfolio = {"ridge": (L.Ridge, {"alpha": H.Param(0.01, 100.0, log=True)}), "tree": (lambda max_depth: R.DecisionTree("regression", max_depth=max_depth), {"max_depth": H.Param(1, 3, "int")})}
    m = H.AutoML(portfolio, max_trials=4, folds=2).fit(_line(spark, d), ["l_quantity", "l_tax"], "l_extendedprice", ["id"])
    return rounded(spark.createDataFrame([(r["rank"], r["model"], r["mean"]) for r in m.leaderboard()], "rank int, model string, mean double"), ["mean"], 4)


@register("meta_features")
def meta_features(spark, d):
    found = H.meta_features(_line(spark, d), XS, "big")
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in found.items()], "feature string, value double"), ["value"], 5)


@register("recommend")
def recommend(spark, d):
    return spark.createDataFrame(H.recommend(H.meta_features(_line(spark, d), XS, "big"), "classification"), "model string, score double, reason string")


@register("gaussian_process")
def gaussian_process(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_suppkey").cast("double").alias("x"), "s_acctbal")
    return rounded(G.GaussianProcessRegressor(G.Kernel("rbf", 10.0), 0.1).fit(df, ["x"], "s_acctbal").predict(df).select("x", "prediction", "std"), ["prediction", "std"], 3)


def _accounts(spark, d, name, c):
    """Small tables as a whole, for models that hold their rows on the driver."""
    key = {"supplier": "s_suppkey", "customer": "c_custkey"}[name]
    return table(spark, d, name).select(F.col(f"{c}_nationkey").cast("double").alias("nation"), (F.col(key) % 97).cast("double").alias("key"), (F.col(f"{c}_acctbal") > 4500).cast("int").alias("rich"))


@register("kernel_svc")
def kernel_svc(spark, d):
    df = _accounts(spark, d, "supplier", "s")
    return G.SVC().fit(df, ["nation", "key"], "rich").predict(df).groupBy("prediction").count()


@register("mlp_classifier")
def mlp_classifier(spark, d):
    df = _accounts(spark, d, "customer", "c")
    return G.MLP((8,), epochs=5).fit(df, ["nation", "key"], "rich").predict(df).groupBy("prediction").count()


@register("partial_fit_merge", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(*), 3) AS m2 FROM events GROUP BY 1")
def partial_fit_merge(spark, d):
    df = table(spark, d, "events")
    parts = [moments(df.filter(F.col("event_id") % 3 == i), "value", ["event_type"]) for i in range(3)]
    return rounded(rounded(merge_moments(merge_moments(parts[0], parts[1], ["event_type"]), parts[2], ["event_type"]), ["mean"]), ["m2"], 3)


@register("windowed_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts_query(spark, d):
    return rounded(windowed_counts(table(spark, d, "events"), "ts", ["event_type"]), ["total"], 4)


@register("drift")
def drift_query(spark, d):
    df = table(spark, d, "events")
    return rounded(drift(df.filter("event_id % 2 = 0"), df.filter("event_id % 2 = 1"), "value"), ["psi", "mean_shift"])


@register("generated_regression")
def generated_regression(spark, d):
    df = files.make_regression(spark, 1000, 4, 2, 0.1)
    m = L.LinearRegression().fit(df, ["x0", "x1", "x2", "x3"], "y")
    return rounded(_row(spark, r2=m.r2), ["r2"], 3)


@register("generated_shapes", "SELECT shape, y::BIGINT AS y, 100::BIGINT AS n FROM (VALUES ('moons'), ('circles'), ('classes'), ('blobs')) s(shape), (VALUES (0), (1)) v(y)")
def generated_shapes(spark, d):
    made = {"moons": files.make_moons(spark, 200, 0.1), "circles": files.make_circles(spark, 200), "classes": files.make_classification(spark, 200, 2, 2), "blobs": files.make_blobs(spark, 200, 2, 2)}
    out = None
    for name, df in made.items():
        part = df.groupBy("y").agg(F.count("*").alias("n")).select(F.lit(name).alias("shape"), "y", "n")
        out = part if out is None else out.unionByName(part)
    return out
