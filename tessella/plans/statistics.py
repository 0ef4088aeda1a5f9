"""Queries over metrics, statistics, tests, selection and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import metrics as M
from tessella.operators import neighbors as N
from tessella.operators import selection as K
from tessella.operators import stats as T
from tessella.plans.registry import register, rounded, table

_PRED = "p AS (SELECT doc_id, toxic::BIGINT AS y, quality::BIGINT AS p, ((doc_id * 37) % 101) / 100.0::DOUBLE AS s, (((doc_id * 37) % 101) / 100.0::DOUBLE + toxic) / 2 AS q FROM labels)"


def _pred(spark, d):
    s = ((F.col("doc_id") * 37) % 101) / F.lit(100.0)
    return table(spark, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("y"), F.col("quality").cast("long").alias("p"), s.alias("s"), ((s + F.col("toxic")) / 2).alias("q"))


@register("confusion_matrix", f"WITH {_PRED}, l AS (SELECT DISTINCT unnest([y, p]) AS l FROM p) SELECT a.l AS truth, b.l AS prediction, count(doc_id) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.y = a.l AND p.p = b.l GROUP BY ALL")
def confusion_matrix(spark, d):
    return M.confusion(_pred(spark, d), "y", "p")


_REPORT = f"""{_PRED}, l AS (SELECT DISTINCT unnest([y, p]) AS label FROM p),
r AS (SELECT label, count(*) FILTER (y = label) AS support, count(*) FILTER (p.p = label) AS predicted, count(*) FILTER (y = label AND p.p = label) AS hit FROM l, p GROUP BY label),
s AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM r),
t AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)"""


@register("classification_report", f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted, hit FROM t")
def classification_report(spark, d):
    return rounded(M.classification_report(_pred(spark, d), "y", "p"), ["precision", "recall", "f1"])


@register(
    "classification_scores",
    f"""WITH {_REPORT}, a AS (SELECT sum(support)::DOUBLE AS n, sum(hit)::DOUBLE AS h, sum(support::DOUBLE * predicted) AS e, sum(support::DOUBLE ** 2) AS ss, sum(predicted::DOUBLE ** 2) AS pp FROM t)
    SELECT any_value(n)::BIGINT AS n, round(any_value(h / n), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(sum(precision * support) / any_value(n), 6) AS precision_weighted, round(avg(recall), 6) AS recall_macro, round(sum(recall * support) / any_value(n), 6) AS recall_weighted,
    round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / any_value(n), 6) AS f1_weighted, round(any_value(h / n), 6) AS f1_micro, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy,
    round(any_value((h * n - e) / sqrt((n * n - ss) * (n * n - pp))), 6) AS mcc, round(any_value((h / n - e / n / n) / (1 - e / n / n)), 6) AS kappa FROM t, a""",
)
def classification_scores(spark, d):
    df = M.classification_scores(_pred(spark, d), "y", "p")
    return rounded(df, [c for c in df.columns if c != "n"])


@register(
    "roc_auc",
    f"WITH {_PRED}, g AS (SELECT q, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM p GROUP BY q), c AS (SELECT *, sum(a) OVER (ORDER BY q DESC) AS t FROM g) SELECT round(sum(b * (t - a / 2)) / (sum(a) * sum(b)), 6)::DOUBLE AS roc_auc FROM c",
)
def roc_auc(spark, d):
    return rounded(M.roc_auc(_pred(spark, d), "y", "q"), ["roc_auc"])


@register("roc_points", f"WITH {_PRED}, g AS (SELECT q, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM p GROUP BY q) SELECT round(q, 6) AS threshold, (sum(a) OVER (ORDER BY q DESC))::BIGINT AS tp, (sum(b) OVER (ORDER BY q DESC))::BIGINT AS fp FROM g")
def roc_points(spark, d):
    return rounded(M.roc_points(_pred(spark, d), "y", "q").select("threshold", "tp", "fp"), ["threshold"])


@register(
    "pr_auc",
    f"""WITH {_PRED}, o AS (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS k, sum(y) OVER (ORDER BY s DESC, doc_id) AS t, sum(y) OVER () AS n FROM p),
    e AS (SELECT k, t / n AS r, max(t / k) OVER (ORDER BY k DESC) AS pr FROM o),
    f AS (SELECT r - coalesce(lag(r) OVER (ORDER BY k), 0) AS step, pr, coalesce(lag(pr) OVER (ORDER BY k), 1) AS before FROM e)
    SELECT round(sum(step * (pr + before) / 2), 6) AS pr_auc, round(sum(step * pr), 6) AS average_precision FROM f""",
)
def pr_auc(spark, d):
    return rounded(M.pr_auc(_pred(spark, d), "y", "s", "doc_id"), ["pr_auc", "average_precision"])


@register("probability_scores", f"WITH {_PRED}, c AS (SELECT y, s, least(greatest(s, 1e-15), 1 - 1e-15) AS z FROM p) SELECT round(avg(-(y * ln(z) + (1 - y) * ln(1 - z))), 6) AS log_loss, round(avg((s - y) ** 2), 6) AS brier, round(1 - avg((s - y) ** 2) / (avg(y) * (1 - avg(y))), 6) AS brier_skill FROM c")
def probability_scores(spark, d):
    return rounded(M.probability_scores(_pred(spark, d), "y", "s"), ["log_loss", "brier", "brier_skill"])


@register("calibration_curve", f"WITH {_PRED}, b AS (SELECT floor(least(greatest(q, 0), 1 - 1e-10) * 10)::INT AS bin, q, y FROM p), r AS (SELECT unnest(range(10))::INT AS bin) SELECT r.bin, round(coalesce(avg(q), 0), 6) AS mean_predicted, round(coalesce(avg(y), 0), 6) AS fraction_positive, count(q) AS n FROM r LEFT JOIN b USING (bin) GROUP BY r.bin")
def calibration_curve(spark, d):
    return rounded(M.calibration_curve(_pred(spark, d), "y", "q"), ["mean_predicted", "fraction_positive"])


_REG = "l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem"


@register(
    "regression_scores",
    f"""WITH a AS (SELECT y, p, y - p AS e FROM (SELECT {_REG})) SELECT round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2,
    round(1 - var_pop(e) / var_pop(y), 6) AS explained_variance, round(max(abs(e)), 4) AS max_error, round(quantile_cont(abs(e), 0.5), 4) AS median_absolute_error, round(avg(abs(e / y)), 6) AS mape FROM a""",
)
def regression_scores(spark, d):
    df = M.regression_scores(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")), "y", "p")
    df = rounded(df, ["mse"], 2)
    df = rounded(df, ["rmse", "mae", "max_error", "median_absolute_error"], 4)
    return rounded(df, ["r2", "explained_variance", "mape"])


@register("forecast_scores", "WITH a AS (SELECT value AS y, 50.0 AS p, abs(value - lag(value) OVER (ORDER BY event_id)) AS n FROM events) SELECT round(100 * avg(2 * abs(y - p) / (abs(y) + p)), 6) AS smape, round(avg(abs(y - p)) / avg(n), 6) AS mase FROM a")
def forecast_scores(spark, d):
    df = table(spark, d, "events").select("event_id", "value", F.lit(50.0).alias("p"))
    return rounded(M.forecast_scores(df, "value", "p", ["event_id"]), ["smape", "mase"])


@register(
    "clustering_agreement",
    """WITH c AS (SELECT label AS a, vec_id % 7 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), x AS (SELECT sum(n) AS n FROM c GROUP BY a), y AS (SELECT sum(n) AS n FROM c GROUP BY b),
    s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l, sum(n) AS t FROM c), p AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l FROM x), q AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l FROM y)
    SELECT round((s.s - p.s * q.s / (t * (t - 1) / 2)) / ((p.s + q.s) / 2 - p.s * q.s / (t * (t - 1) / 2)), 6) AS ari,
    round((ln(t) + s.l / t - p.l / t - q.l / t) / ((2 * ln(t) - p.l / t - q.l / t) / 2), 6) AS nmi FROM s, p, q""",
)
def clustering_agreement(spark, d):
    return rounded(M.clustering_agreement(table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("k")), "label", "k"), ["ari", "nmi"])


_PAIRS = "v AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v, label AS k FROM embeddings), d AS (SELECT a.i, b.i AS j, a.k, b.k AS l, list_distance(a.v, b.v) AS d FROM v a, v b)"


@register(
    "silhouette",
    f"WITH {_PAIRS}, m AS (SELECT i, k, l, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT i, max(CASE WHEN k = l THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN k <> l THEN s / n END) AS b FROM m GROUP BY i) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p",
)
def silhouette(spark, d):
    return rounded(M.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label"), ["silhouette"])


@register(
    "cluster_separation",
    """WITH f AS (SELECT vec_id AS i, label AS k, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), o AS (SELECT d, avg(x) AS m FROM f GROUP BY d),
    c AS (SELECT k, d, avg(x) AS c, count(*) AS n, var_pop(x) * count(*) AS w FROM f GROUP BY k, d), b AS (SELECT sum(n * (c - m) ** 2) AS b, sum(w) AS w, count(DISTINCT k) AS g FROM c JOIN o USING (d)),
    r AS (SELECT f.k, i, sqrt(sum((x - c) ** 2)) AS r FROM f JOIN c ON c.k = f.k AND c.d = f.d GROUP BY f.k, i), s AS (SELECT k, avg(r) AS s FROM r GROUP BY k),
    g AS (SELECT a.k, z.k AS l, sqrt(sum((a.c - z.c) ** 2)) AS g FROM c a JOIN c z ON a.d = z.d AND a.k <> z.k GROUP BY a.k, z.k),
    db AS (SELECT g.k, max((s.s + t.s) / g) AS r FROM g JOIN s ON s.k = g.k JOIN s t ON t.k = g.l GROUP BY g.k)
    SELECT round(b / (g - 1) / (w / ((SELECT count(*) FROM embeddings) - g)), 4) AS calinski_harabasz, round((SELECT avg(r) FROM db), 6) AS davies_bouldin, round(w, 3) AS within_ss, round(b, 3) AS between_ss FROM b""",
)
def cluster_separation(spark, d):
    df = M.cluster_separation(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return rounded(rounded(rounded(df, ["calinski_harabasz"], 4), ["davies_bouldin"], 6), ["within_ss", "between_ss"], 3)


@register("dunn_index", f"WITH {_PAIRS} SELECT round(min(d) FILTER (k <> l) / max(d) FILTER (k = l), 6) AS dunn FROM d WHERE i < j")
def dunn_index(spark, d):
    return rounded(M.dunn_index(table(spark, d, "embeddings"), "vec_id", "embedding", "label"), ["dunn"])


_STATS = ["mean", "std", "sem", "median", "q1", "q3", "iqr", "skewness", "kurtosis"]


@register(
    "descriptive_by_type",
    "SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(stddev_samp(value) / sqrt(count(value)), 5) AS sem, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.25), 5) AS q1, round(quantile_cont(value, 0.75), 5) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 5) AS iqr, round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis FROM events GROUP BY event_type",
)
def descriptive_by_type(spark, d):
    return rounded(T.descriptive(table(spark, d, "events"), "value", ["event_type"]), _STATS, 5)


@register("pearson", "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(spark, d):
    return rounded(T.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), ["r"])


_GROUPS = "m AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n1, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1, count(*) FILTER (o_orderstatus = 'O') AS n2, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m2, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS v2 FROM orders), p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS s, v1 / n1 + v2 / n2 AS e FROM m)"


@register(
    "effect_sizes",
    f"""WITH {_GROUPS} SELECT round((m1 - m2) / sqrt(s), 6) AS cohens_d, round((m1 - m2) / sqrt(s) * (1 - 3 / (4.0 * (n1 + n2 - 2) - 1)), 6) AS hedges_g, round((m1 - m2) / sqrt(v2), 6) AS glass_delta,
    round((m1 - m2) / sqrt(s * (1.0 / n1 + 1.0 / n2)), 6) AS t_pooled, (n1 + n2 - 2)::DOUBLE AS df_pooled, round((m1 - m2) / sqrt(e), 6) AS t_welch, round(e ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df_welch FROM p""",
)
def effect_sizes(spark, d):
    df = T.effect_sizes(T.two_groups(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O"))
    return rounded(rounded(df, ["cohens_d", "hedges_g", "glass_delta", "t_pooled", "t_welch"]), ["df_welch"], 4)


@register(
    "mann_whitney_u",
    """WITH r AS (SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS r FROM orders WHERE o_orderstatus IN ('F', 'O')),
    s AS (SELECT sum(r) FILTER (g = 'F') AS r1, count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2 FROM r), u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u FROM s)
    SELECT round(u, 2)::DOUBLE AS u, round((u - n1 * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12), 6) AS z, n1, n2 FROM u""",
)
def mann_whitney_u(spark, d):
    return rounded(rounded(T.mann_whitney_u(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O"), ["u"], 2), ["z"])


@register("durbin_watson", "SELECT round(sum((value - b) ** 2) / sum(value ** 2), 6) AS durbin_watson FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS b FROM events)")
def durbin_watson(spark, d):
    return rounded(T.durbin_watson(table(spark, d, "events"), "value", ["event_id"]), ["durbin_watson"])


@register("iqr_outliers", "WITH o AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), q AS (SELECT max(v) FILTER (i = n // 4) AS a, max(v) FILTER (i = 3 * n // 4) AS b FROM o) SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def iqr_outliers(spark, d):
    return T.iqr_outliers(table(spark, d, "events").select("event_id", "value"), "value", ["event_id"])


@register("goldfeld_quandt", "WITH o AS (SELECT value ** 2 AS q, row_number() OVER (ORDER BY event_id) - 1 >= count(*) OVER () // 2 AS late FROM events) SELECT round(avg(q) FILTER (late) / avg(q) FILTER (NOT late), 6) AS ratio, count(*) FILTER (late) AS n_late, count(*) FILTER (NOT late) AS n_early FROM o")
def goldfeld_quandt(spark, d):
    return rounded(T.goldfeld_quandt(table(spark, d, "events"), "value", ["event_id"]), ["ratio"])


@register("mcnemar", f"WITH {_PRED}, c AS (SELECT count(*) FILTER (y = p.p AND y <> (s > 0.5)::INT) AS b, count(*) FILTER (y <> p.p AND y = (s > 0.5)::INT) AS c FROM p) SELECT b, c, round(greatest(abs(b - c) - 1, 0) ** 2 / (b + c), 6) AS statistic FROM c")
def mcnemar(spark, d):
    df = _pred(spark, d).withColumn("r", (F.col("s") > 0.5).cast("long"))
    return rounded(T.mcnemar(df, "y", "p", "r"), ["statistic"])


@register(
    "wilcoxon",
    """WITH d AS (SELECT l_quantity - 25 AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d),
    s AS (SELECT count(*)::DOUBLE AS n, sum(r) FILTER (d > 0) AS w, sum(t::DOUBLE ** 2 - 1) AS ties FROM r) SELECT n, w::DOUBLE AS w_plus, round((abs(w - n * (n + 1) / 4) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""",
)
def wilcoxon(spark, d):
    return rounded(T.wilcoxon(table(spark, d, "lineitem").withColumn("m", F.lit(25.0)), "l_quantity", "m"), ["z"])


@register("eta_squared", "WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g) SELECT round(b / (b + w), 8) AS eta_squared, round((b - (k - 1) * w / (n - k)) / (b + w + w / (n - k)), 8) AS omega_squared FROM s")
def eta_squared(spark, d):
    return rounded(T.eta_squared(table(spark, d, "events"), "value", "event_type"), ["eta_squared", "omega_squared"], 8)


_P = "p AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 1009 + 1) / 20000.0::DOUBLE AS p FROM supplier), r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p)"
_ADJUSTED = {
    "bonferroni": "least(p * n, 1)",
    "holm": "least(max(p * (n - i + 1)) OVER (ORDER BY i), 1)",
    "hochberg": "least(min(p * (n - i + 1)) OVER (ORDER BY i DESC), 1)",
    "bh": "least(min(p * n / i) OVER (ORDER BY i DESC), 1)",
    "by": "least(min(p * n * (SELECT sum(1.0::DOUBLE / x) FROM (SELECT unnest(range(1, (SELECT count(*) FROM supplier) + 1)) AS x)) / i) OVER (ORDER BY i DESC), 1)",
}
for _method, _sql in _ADJUSTED.items():

    @register(f"adjust_{_method}", f"WITH {_P} SELECT id, p, round({_sql}, 8) AS adjusted FROM r")
    def adjust(spark, d, method=_method):
        df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (((F.col("s_suppkey") * 7919) % 1009 + 1) / F.lit(20000.0)).alias("p"))
        return rounded(T.adjust_p_values(df, "p", method, "id"), ["adjusted"], 8)


@register(
    "f_classif_lineitem",
    """WITH s AS (SELECT * FROM (SELECT l_returnflag AS y, l_quantity, l_extendedprice, l_discount FROM lineitem) UNPIVOT (x FOR feature IN (l_quantity, l_extendedprice, l_discount))),
    g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY ALL), t AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g GROUP BY feature)
    SELECT feature, round((b / (k - 1)) / (w / (n - k)), 5) AS score, (k - 1)::BIGINT AS df_between, (n - k)::BIGINT AS df_within FROM t""",
)
def f_classif_lineitem(spark, d):
    return rounded(K.f_classif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"), ["score"], 5)


@register(
    "f_regression_lineitem",
    """WITH s AS (SELECT * FROM (SELECT l_extendedprice AS y, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (x FOR feature IN (l_quantity, l_discount, l_tax))),
    g AS (SELECT feature, corr(x, y) ** 2 AS r, count(*) AS n FROM s GROUP BY feature) SELECT feature, round(r * (n - 2) / (1 - r), 4) AS score, n FROM g""",
)
def f_regression_lineitem(spark, d):
    return rounded(K.f_regression(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), ["score"], 4)


@register(
    "chi2_scores",
    """WITH s AS (SELECT * FROM (SELECT l_returnflag AS y, l_quantity, l_tax FROM lineitem) UNPIVOT (x FOR feature IN (l_quantity, l_tax))),
    g AS (SELECT feature, y, sum(x) AS o, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM g)
    SELECT feature, round(sum((o - e) ** 2 / e), 5) AS score, count(*) - 1 AS df FROM e GROUP BY feature""",
)
def chi2_scores(spark, d):
    return rounded(K.chi2(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag"), ["score"], 5)


@register("select_k_best")
def select_k_best(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    chosen = K.SelectKBest(2).fit(df, columns, "l_returnflag").transform(df)
    kept = [c for c in chosen.columns if c in columns]
    return chosen.agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, kept))).alias("feature"), "n")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_NEAR = "v AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v, label AS k FROM embeddings), n AS (SELECT a.i AS q, b.i AS j, a.k AS yq, b.k AS yj, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.v, b.v), b.i) AS r FROM v a JOIN v b ON a.i <> b.i)"


@register("knn_top3", f"WITH {_NEAR} SELECT q AS query, j AS neighbor, round(d, 6) AS distance, r::INT AS rank FROM n WHERE r <= 3")
def knn_top3(spark, d):
    v = _vectors(spark, d)
    return rounded(N.neighbors(v, v, 3, exclude_self=True), ["distance"])


_SPLIT = "a AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 = 0), b AS (SELECT vec_id AS j, embedding::DOUBLE[] AS v, label AS y FROM embeddings WHERE vec_id % 5 <> 0), n AS (SELECT i, y, d FROM (SELECT i, y, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY i ORDER BY list_distance(a.v, b.v), j) AS r FROM a, b) WHERE r <= 5)"


@register("knn_classify", f"WITH {_SPLIT}, c AS (SELECT i, y, count(*) AS n FROM n GROUP BY i, y) SELECT i AS query, y AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, y) AS r FROM c) WHERE r = 1")
def knn_classify(spark, d):
    v = _vectors(spark, d)
    return N.KNeighborsClassifier(5).fit(v.filter("id % 5 <> 0"), "label").predict(v.filter("id % 5 = 0"))


@register("knn_regress", f"WITH {_SPLIT} SELECT i AS query, round(sum(y / (d + 1e-10)) / sum(1 / (d + 1e-10)), 6) AS prediction FROM n GROUP BY i")
def knn_regress(spark, d):
    v = _vectors(spark, d)
    return rounded(N.KNeighborsRegressor(5, "distance").fit(v.filter("id % 5 <> 0"), "label").predict(v.filter("id % 5 = 0")), ["prediction"])


@register(
    "nearest_centroid",
    """WITH f AS (SELECT label AS k, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT k, list(m ORDER BY d) AS c FROM (SELECT k, d, avg(x) AS m FROM f GROUP BY k, d) GROUP BY k)
    SELECT vec_id AS query, arg_min(k, {'d': list_distance(embedding::DOUBLE[], c), 'k': k}) AS prediction FROM embeddings, c GROUP BY vec_id""",
)
def nearest_centroid(spark, d):
    v = _vectors(spark, d)
    return N.NearestCentroid().fit(v, "label").predict(v)


@register(
    "lof_scores",
    f"""WITH {_NEAR}, k AS (SELECT * FROM n WHERE r <= 10), e AS (SELECT q, max(d) AS kd FROM k GROUP BY q), l AS (SELECT k.q, 1 / avg(greatest(e.kd, k.d)) AS lrd FROM k JOIN e ON e.q = k.j GROUP BY k.q)
    SELECT k.q AS query, round(any_value(a.lrd), 6) AS lrd, round(-avg(b.lrd / a.lrd), 6) AS score FROM k JOIN l a ON a.q = k.q JOIN l b ON b.q = k.j GROUP BY k.q""",
)
def lof_scores(spark, d):
    return rounded(N.local_outlier_factor(_vectors(spark, d), 10), ["lrd", "score"])


@register("tomek_links", f"WITH {_NEAR}, m AS MATERIALIZED (SELECT * FROM n WHERE r = 1) SELECT a.q AS a, a.j AS b FROM m a JOIN m b ON a.q = b.j AND a.j = b.q WHERE a.q < a.j AND a.yq <> a.yj")
def tomek_links(spark, d):
    return N.tomek_links(_vectors(spark, d), "label")


@register("enn_removed", f"WITH {_NEAR} SELECT q AS id FROM n WHERE r <= 3 GROUP BY q HAVING count(*) FILTER (yq <> yj) * 2 > 3")
def enn_removed(spark, d):
    return N.edited_nearest(_vectors(spark, d), "label", 3, "mode")


@register("under_sample_counts", "SELECT toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n FROM labels GROUP BY toxic")
def under_sample_counts(spark, d):
    return N.random_under_sample(table(spark, d, "labels"), "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))


@register("over_sample_counts", "SELECT toxic, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n FROM labels GROUP BY toxic")
def over_sample_counts(spark, d):
    return N.random_over_sample(table(spark, d, "labels"), "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))


def _imbalanced(spark, d):
    return _vectors(spark, d).withColumn("label", (F.col("label") >= 8).cast("int"))


@register("smote_counts", "SELECT (k)::INT AS label, (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label >= 8)) AS n FROM (VALUES (0), (1)) v(k)")
def smote_counts(spark, d):
    return N.smote(_imbalanced(spark, d), "label").groupBy("label").agg(F.count("*").alias("n"))


def _resampled(m: int, condition: str) -> str:
    """The minority reaches the majority if any of its rows qualifies by the share of other classes among its m nearest."""
    return f"""WITH {_NEAR}, h AS (SELECT q, avg(((yq >= 8) <> (yj >= 8))::INT) AS share, any_value(yq >= 8) AS minority FROM n WHERE r <= {m} GROUP BY q), c AS (SELECT count(*) FILTER (label < 8) AS n0, count(*) FILTER (label >= 8) AS n1 FROM embeddings), e AS (SELECT count(*) AS d FROM h WHERE minority AND {condition})
    SELECT 0 AS label, n0 AS n FROM c UNION ALL SELECT 1, CASE WHEN d > 0 THEN greatest(n0, n1) ELSE n1 END FROM c, e"""


@register("borderline_smote_counts", _resampled(10, "share >= 0.5 AND share < 1"))
def borderline_smote_counts(spark, d):
    return N.borderline_smote(_imbalanced(spark, d), "label").groupBy("label").agg(F.count("*").alias("n"))


@register("adasyn_counts", _resampled(5, "share > 0"))
def adasyn_counts(spark, d):
    return N.adasyn(_imbalanced(spark, d), "label").groupBy("label").agg(F.count("*").alias("n"))


@register("smote_tomek_counts")
def smote_tomek_counts(spark, d):
    return N.smote_tomek(_imbalanced(spark, d), "label").groupBy("label").agg(F.count("*").alias("n"))


@register("smote_enn_counts")
def smote_enn_counts(spark, d):
    return N.smote_enn(_imbalanced(spark, d), "label", kind="mode").groupBy("label").agg(F.count("*").alias("n"))


@register("isolation_scores")
def isolation_scores(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice")
    return rounded(N.IsolationForest(20).fit(df, ["l_quantity", "l_extendedprice"], "id").score(df, "id"), ["score"])


@register("bootstrap_means")
def bootstrap_means(spark, d):
    return rounded(T.bootstrap_means(table(spark, d, "labels"), "toxic", "doc_id", 50), ["value"])
