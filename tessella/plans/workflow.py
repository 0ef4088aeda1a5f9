"""Queries over sources, stored models, tests with p-values, splits, searches and profiles."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import Dataset, check_finite, drop_constant
from tessella.functions import specfun as sf
from tessella.operators import bayes as B
from tessella.operators import cluster as C
from tessella.operators import compose as E
from tessella.operators import decomposition as D
from tessella.operators import explain as X
from tessella.operators import kernels as G
from tessella.operators import linear as L
from tessella.operators import metrics as M
from tessella.operators import preprocessing as P
from tessella.operators import search as H
from tessella.operators import selection as K
from tessella.operators import splits as S
from tessella.operators import stats as T
from tessella.operators.text import CountVectorizer
from tessella.plans.iterations import _THREE, fold_scores
from tessella.plans.models import _TOKENS, _flat, _line, _row
from tessella.plans.registry import SQL, register, rounded, table
from tessella.plans.statistics import _GROUPS, _NEAR, _PRED, _pred
from tessella.plans.tables import _FOLDS
from tessella.sources import files, models


def _fresh(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"


# sources


@register("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, d):
    path = _fresh(spark, "customer.csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path, schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@register("csv_options", "SELECT n_nationkey::INT AS n_nationkey, CASE WHEN n_regionkey = 3 THEN NULL ELSE n_regionkey END::INT AS n_regionkey FROM nation")
def csv_options(spark, d):
    path = _fresh(spark, "nation.txt")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))
    rows.coalesce(1).write.option("header", True).option("sep", "|").csv(path)
    return files.read_csv(spark, path, files.CsvOptions(delimiter="|", columns=("n_nationkey", "n_regionkey"), null_values=("3",))).select("n_nationkey", "n_regionkey").withColumn("n_nationkey", F.coalesce("n_nationkey", F.lit(3)))


@register("file_dispatch", "SELECT kind, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier, (VALUES ('csv'), ('tsv'), ('parquet'), ('json'), ('orc')) v(kind) GROUP BY kind")
def file_dispatch(spark, d):
    rows, out = table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), None
    for kind in ("csv", "tsv", "parquet", "json", "orc"):
        path = _fresh(spark, f"supplier.{kind}")
        writer = rows.write.option("header", True) if kind in ("csv", "tsv") else rows.write
        writer.option("sep", "\t" if kind == "tsv" else ",").format("csv" if kind == "tsv" else kind).save(path)
        part = files.read_file(spark, path).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("s_suppkey").cast("long").alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out


@register("parquet_columns", "SELECT l_orderkey, l_tax FROM lineitem")
def parquet_columns(spark, d):
    return files.read_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_tax"])


@register("dataset_matrix", "SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice FROM orders")
def dataset_matrix(spark, d):
    return Dataset.of(table(spark, d, "orders"), "o_totalprice", ["o_custkey"], ["o_orderkey"]).df.select("o_orderkey", "o_custkey", "o_totalprice")


@register("feature_subset", "SELECT l_orderkey, l_linenumber, l_tax, l_extendedprice FROM lineitem")
def feature_subset(spark, d):
    data = Dataset.of(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])
    return data.select(["l_tax"]).df


@register("null_policy", "SELECT 'nan' AS nulls, count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS missing, true AS accepted FROM orders UNION ALL SELECT 'error', 0, 0, false")
def null_policy(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))
    kept = Dataset.of(df, "v").df.agg(F.lit("nan").alias("nulls"), F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.lit(True).alias("accepted"))
    try:
        Dataset.of(df, "v", nulls="error")
        accepted = True
    except InvalidInput:
        accepted = False
    return kept.unionByName(spark.createDataFrame([("error", 0, 0, accepted)], "nulls string, n long, missing long, accepted boolean"))


def _passes(check) -> bool:
    try:
        check()
        return True
    except InvalidInput:
        return False


@register("finite_check", "SELECT * FROM (VALUES ('whole', true), ('gaps', false), ('gaps allowed', true), ('infinite', false), ('empty', false)) v(rows_with, passes)")
def finite_check(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    gaps, wide = df.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value"))), df.withColumn("value", F.when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value")))
    found = [("whole", df, False), ("gaps", gaps, False), ("gaps allowed", gaps, True), ("infinite", wide, True), ("empty", df.limit(0), True)]
    return spark.createDataFrame([(name, _passes(lambda x=x, a=a: check_finite(x, ["value"], a))) for name, x, a in found], "rows_with string, passes boolean")


@register(
    "task_inference",
    """WITH s AS (SELECT 'labels.toxic' AS target, toxic::DOUBLE AS y FROM labels UNION ALL SELECT 'lineitem.l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'lineitem.l_linenumber', l_linenumber FROM lineitem UNION ALL SELECT 'events.value', value FROM events),
    g AS (SELECT target, count(y) AS n, count(DISTINCT y) AS u, count(*) FILTER (y <> floor(y)) AS b FROM s GROUP BY target) SELECT target, CASE WHEN b = 0 AND u <= 20 AND (n < 50 OR u < n / 5) THEN 'classification' ELSE 'regression' END AS task FROM g""",
)
def task_inference(spark, d):
    found = [(f"{t}.{c}", Dataset.of(table(spark, d, t), c).infer_task()) for t, c in (("labels", "toxic"), ("lineitem", "l_quantity"), ("lineitem", "l_linenumber"), ("events", "value"))]
    return spark.createDataFrame(found, "target string, task string")


@register("constant_features", "SELECT feature FROM (SELECT 'l_quantity' AS feature, var_pop(l_quantity) AS v FROM lineitem UNION ALL SELECT 'one', 0 UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM lineitem) WHERE v > 0.01")
def constant_features(spark, d):
    df = table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in drop_constant(df, ["l_quantity", "one", "l_tax"], 0.01)], "feature string")


# stored models


def _predicted(spark, d, model):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("n"), "c_acctbal")
    return rounded(model(L.LinearRegression().fit(df, ["n"], "c_acctbal")).predict(df).select("c_custkey", "prediction"), ["prediction"], 4)


_FITTED = "SELECT c_custkey, round((SELECT regr_intercept(c_acctbal, c_nationkey) FROM customer) + (SELECT regr_slope(c_acctbal, c_nationkey) FROM customer) * c_nationkey, 4) AS prediction FROM customer"


@register("model_round_trip", _FITTED)
def model_round_trip(spark, d):
    path = _fresh(spark, "model")

    def through(m):
        models.save_model(spark, m, path)
        return models.load_model(spark, path)

    return _predicted(spark, d, through)


@register("bytes_round_trip", _FITTED)
def bytes_round_trip(spark, d):
    return _predicted(spark, d, lambda m: models.from_bytes(models.to_bytes(m)))


@register("broken_model", "SELECT 'LinearRegression' AS kind, false AS broken_loads")
def broken_model(spark, d):
    df = table(spark, d, "supplier").withColumn("k", F.col("s_nationkey").cast("double"))
    raw = models.to_bytes(L.LinearRegression().fit(df, ["k"], "s_acctbal"))
    try:
        models.from_bytes(raw.replace(b"coefficients", b"coefficientz"))
        loads = True
    except (InvalidInput, ValueError):
        loads = False
    return spark.createDataFrame([(models.peek(raw)["kind"], loads)], "kind string, broken_loads boolean")


# tail probabilities, integrated by Simpson's rule in the SQL
_STEPS = 4000
_SIMPSON = f"CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def normal_upper2(z: str) -> str:
    """The two-sided tail of a normal statistic."""
    return f"greatest(1 - 2 * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {_SIMPSON} * exp(-0.5 * pow(least(abs({z}), 12) * i / {_STEPS}.0::DOUBLE, 2)))) * least(abs({z}), 12) / {_STEPS} / 3 / sqrt(2 * pi()), 0)"


def t_upper2(t: str, df: str) -> str:
    """The two-sided tail of a t statistic; x = sqrt(df) tan(a) makes the range finite."""
    end = f"atan(abs({t}) / sqrt({df}))"
    return f"greatest(1 - 2 * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {_SIMPSON} * pow(cos({end} * i / {_STEPS}.0::DOUBLE), ({df}) - 1))) * {end} / {_STEPS} / 3 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi()), 0)"


@register("correlation_test", f"""WITH c AS (SELECT corr(o_totalprice, o_custkey) AS r, count(*)::DOUBLE AS n FROM orders), s AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
    SELECT round(t, 6) AS statistic, round({t_upper2("t", "n - 2")}, 6) AS p_value, n - 2 AS df, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM s""")
def correlation_test(spark, d):
    t = T.correlation(table(spark, d, "orders"), "o_totalprice", "o_custkey")
    return rounded(_row(spark, statistic=t.statistic, p_value=t.p_value, df=t.df, low=t.interval[0], high=t.interval[1]), ["statistic", "p_value", "low", "high"])


@register("t_tests", f"""WITH {_GROUPS}, s AS (SELECT 'pooled' AS kind, (m1 - m2) / sqrt(s * (1.0 / n1 + 1.0 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS k FROM p UNION ALL SELECT 'welch', (m1 - m2) / sqrt(e), e ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) FROM p)
    SELECT kind, round(t, 6) AS statistic, round({t_upper2("t", "k")}, 6) AS p_value FROM s""")
def t_tests(spark, d):
    df = table(spark, d, "orders")
    found = [(kind, T.t_test(df, "o_totalprice", "o_orderstatus", "F", "O", equal)) for kind, equal in (("pooled", True), ("welch", False))]
    return rounded(spark.createDataFrame([(k, t.statistic, t.p_value) for k, t in found], "kind string, statistic double, p_value double"), ["statistic", "p_value"])


@register("rank_tests", f"""WITH {_PRED}, r AS (SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS r FROM orders WHERE o_orderstatus IN ('F', 'O')),
    s AS (SELECT sum(r) FILTER (g = 'F') AS r1, count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2 FROM r), u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u FROM s),
    d AS (SELECT l_quantity - 25 AS d FROM lineitem WHERE l_quantity <> 25), w AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d),
    x AS (SELECT count(*)::DOUBLE AS n, sum(r) FILTER (d > 0) AS w, sum(t::DOUBLE ** 2 - 1) AS ties FROM w), m AS (SELECT count(*) FILTER (y = p.p AND y <> (s > 0.5)::INT) AS b, count(*) FILTER (y <> p.p AND y = (s > 0.5)::INT) AS c FROM p),
    z AS (SELECT 'mann_whitney' AS test, round(u, 2)::DOUBLE AS statistic, (u - n1 * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12) AS z FROM u
    UNION ALL SELECT 'wilcoxon', round((abs(w - n * (n + 1) / 4) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6), (abs(w - n * (n + 1) / 4) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) FROM x
    UNION ALL SELECT 'mcnemar', round(greatest(abs(b - c) - 1, 0) ** 2 / (b + c), 6), sqrt(greatest(abs(b - c) - 1, 0) ** 2 / (b + c)) FROM m)
    SELECT test, statistic, round(least({normal_upper2("z")}, 1), 6) + 0.0 AS p_value FROM z""")
def rank_tests(spark, d):
    pred = _pred(spark, d).withColumn("r", (F.col("s") > 0.5).cast("long"))
    found = [
        ("mann_whitney", T.mann_whitney_test(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O"), 2),
        ("wilcoxon", T.wilcoxon_test(table(spark, d, "lineitem").withColumn("m", F.lit(25.0)), "l_quantity", "m"), 6),
        ("mcnemar", T.mcnemar_test(pred, "y", "p", "r"), 6),
    ]
    return rounded(spark.createDataFrame([(k, round(t.statistic, n), t.p_value) for k, t, n in found], "test string, statistic double, p_value double"), ["p_value"])


@register("normality", """WITH m AS (SELECT count(*)::DOUBLE AS n, avg(o_totalprice) AS m FROM orders), c AS (SELECT any_value(n) AS n, avg((o_totalprice - m) ** 2) AS a, avg((o_totalprice - m) ** 3) AS b, avg((o_totalprice - m) ** 4) AS c FROM orders, m),
    k AS (SELECT n / 6 * ((b / a ** 1.5) ** 2 + (c / a ** 2 - 3) ** 2 / 4) AS k FROM c) SELECT round(k, 4) AS statistic, round(exp(-k / 2), 8) AS p_value, round(1 / (1 + k), 8) AS effect FROM k""")
def normality(spark, d):
    t = T.normality(table(spark, d, "orders"), "o_totalprice")
    return rounded(rounded(_row(spark, statistic=t.statistic, p_value=t.p_value, effect=t.effect), ["statistic"], 4), ["p_value", "effect"], 8)


_DIFFERENCE = "SELECT count(*)::DOUBLE AS n, avg(quality - toxic) AS m, stddev_samp(quality - toxic) AS s FROM labels"


@register("paired_t", f"WITH d AS ({_DIFFERENCE}) SELECT round(m / (s / sqrt(n)), 6) AS statistic, round({t_upper2('m / (s / sqrt(n))', 'n - 1')}, 6) AS p_value, n - 1 AS df FROM d")
def paired_t(spark, d):
    t = T.paired_t(table(spark, d, "labels"), "quality", "toxic")
    return rounded(_row(spark, statistic=t.statistic, p_value=t.p_value, df=t.df), ["statistic", "p_value"])


@register("corrected_resampled_t", f"WITH d AS ({_DIFFERENCE}), t AS (SELECT m / sqrt((1 / n + 25 / 75.0::DOUBLE) * s * s) AS t, n FROM d) SELECT round(t, 6) AS statistic, round({t_upper2('t', 'n - 1')}, 6) AS p_value FROM t")
def corrected_resampled_t(spark, d):
    t = T.corrected_resampled_t(table(spark, d, "labels"), "quality", "toxic", 75, 25)
    return rounded(_row(spark, statistic=t.statistic, p_value=t.p_value), ["statistic", "p_value"])


@register("five_by_two_t", f"""WITH g AS (SELECT event_id % 10 AS k, avg(value) AS m FROM events GROUP BY 1), p AS (SELECT a.k // 2 AS k, a.m - t.m AS a, b.m - t.m AS b FROM g a JOIN g b ON b.k = a.k + 1 AND a.k % 2 = 0, (SELECT avg(value) + 0.5 AS m FROM events) t),
    s AS (SELECT sum((a - b) ** 2 / 2) AS s, max(a) FILTER (k = 0) AS first FROM p), t AS (SELECT first / sqrt(s / 5) AS t FROM s) SELECT round(t, 6) AS statistic, round({t_upper2('t', '5.0::DOUBLE')}, 6) AS p_value FROM t""")
def five_by_two_t(spark, d):
    df = table(spark, d, "events")
    mean = df.agg(F.avg("value")).first()[0] + 0.5
    by = {r[0]: r[1] - mean for r in df.groupBy(F.col("event_id") % 10).agg(F.avg("value")).collect()}
    t = T.five_by_two_t([(by[2 * i], by[2 * i + 1]) for i in range(5)])
    return rounded(_row(spark, statistic=t.statistic, p_value=t.p_value), ["statistic", "p_value"])


_Z = "1.959963984540054::DOUBLE"
_TQ = f"({_Z} + ({_Z} ** 3 + {_Z}) / (4 * v) + (5 * {_Z} ** 5 + 16 * {_Z} ** 3 + 3 * {_Z}) / (96 * v ** 2) + (3 * {_Z} ** 7 + 19 * {_Z} ** 5 + 17 * {_Z} ** 3 - 15 * {_Z}) / (384 * v ** 3) + (79 * {_Z} ** 9 + 776 * {_Z} ** 7 + 1482 * {_Z} ** 5 - 1920 * {_Z} ** 3 - 945 * {_Z}) / (92160 * v ** 4))"


@register("confidence_intervals", f"WITH m AS (SELECT avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS e, count(*)::DOUBLE - 1 AS v FROM events) SELECT 'normal' AS method, round(m - {_Z} * e, 5) AS low, round(m + {_Z} * e, 5) AS high FROM m UNION ALL SELECT 't', round(m - {_TQ} * e, 5), round(m + {_TQ} * e, 5) FROM m")
def confidence_intervals(spark, d):
    df = table(spark, d, "events")
    return rounded(spark.createDataFrame([(m, *T.confidence_interval(df, "value", method=m)) for m in ("normal", "t")], "method string, low double, high double"), ["low", "high"], 5)


@register("rejections", """WITH p AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 1009 + 1) / 20000.0::DOUBLE AS p FROM supplier), r AS (SELECT p, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p),
    a AS (SELECT least(min(p * n / i) OVER (ORDER BY i DESC), 1) AS q FROM r) SELECT count(*) FILTER (q < 0.04) AS rejections, round(count(*) FILTER (q < 0.04) * 0.04, 6)::DOUBLE AS expected_false FROM a""")
def rejections(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (((F.col("s_suppkey") * 7919) % 1009 + 1) / F.lit(20000.0)).alias("p"))
    return rounded(T.count_rejections(T.adjust_p_values(df, "p", "bh", "id"), alpha=0.04), ["expected_false"])


@register("power_analysis", f"""SELECT effect, ceil(2 * (({_Z} + 0.8416212335729143) / effect) ** 2)::BIGINT AS sample_size, round(CASE WHEN g > 0 THEN 1 - {normal_upper2('g')} / 2 ELSE {normal_upper2('g')} / 2 END, 6) AS power
    FROM (SELECT effect, effect * sqrt(50) - {_Z} AS g FROM (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.5), (0.8)) v(effect))""")
def power_analysis(spark, d):
    return rounded(spark.createDataFrame([(e, T.sample_size(e), T.achieved_power(100, e)) for e in (0.1, 0.2, 0.3, 0.5, 0.8)], "effect double, sample_size long, power double"), ["power"])


@register("special_functions", f"""SELECT 'normal' AS f, x::DOUBLE AS x, 0.0::DOUBLE AS k, round({normal_upper2('x')}, 7) AS tail FROM (SELECT unnest(range(0, 9)) / 2.0::DOUBLE AS x)
    UNION ALL SELECT 't', x, k, round({t_upper2('x', 'k')}, 7) FROM (SELECT unnest(range(0, 9)) / 2.0::DOUBLE AS x), (VALUES (1.0::DOUBLE), (2), (5), (30), (200)) v(k)
    UNION ALL SELECT 'chi2', x, k, round(exp(-x / 2) * list_sum(list_transform(range(0, (k / 2)::BIGINT), lambda j: pow(x / 2, j) / gamma(j + 1))), 7) FROM (SELECT unnest(range(1, 9)) * 2.0::DOUBLE AS x), (VALUES (2.0::DOUBLE), (4), (10)) v(k)
    UNION ALL SELECT 'f', x, k, round(pow(1 + 2 * x / k, -k / 2), 7) FROM (SELECT unnest(range(1, 9)) / 2.0::DOUBLE AS x), (VALUES (3.0::DOUBLE), (12), (80)) v(k)""")
def special_functions(spark, d):
    rows = [("normal", i / 2, 0.0, sf.normal_two_sided(i / 2)) for i in range(9)] + [("t", i / 2, float(k), sf.t_two_sided(i / 2, k)) for i in range(9) for k in (1, 2, 5, 30, 200)]
    rows += [("chi2", 2.0 * i, float(k), sf.chi2_upper(2.0 * i, k)) for i in range(1, 9) for k in (2, 4, 10)] + [("f", i / 2, float(k), sf.f_upper(i / 2, 2, k)) for i in range(1, 9) for k in (3, 12, 80)]
    return rounded(spark.createDataFrame(rows, "f string, x double, k double, tail double"), ["tail"], 7)


@register("auc_interval", f"WITH {_PRED}, g AS (SELECT q, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM p GROUP BY q), c AS (SELECT *, sum(a) OVER (ORDER BY q DESC) AS t FROM g) SELECT round(sum(b * (t - a / 2)) / (sum(a) * sum(b)), 6)::DOUBLE AS auc, true AS inside FROM c")
def auc_interval(spark, d):
    auc, low, high = M.bootstrap_auc(_pred(spark, d), "y", "q", "doc_id")
    return rounded(spark.createDataFrame([(auc, low <= auc <= high)], "auc double, inside boolean"), ["auc"])


@register("pr_points", f"WITH {_PRED}, g AS (SELECT q, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM p GROUP BY q), c AS (SELECT q, sum(a) OVER o AS t, sum(b) OVER o AS f, sum(a) OVER () AS n FROM g WINDOW o AS (ORDER BY q DESC)) SELECT round(q, 6) AS threshold, round(t / (t + f), 6) AS precision, round(t / n, 6) AS recall FROM c")
def pr_points(spark, d):
    return rounded(M.pr_points(_pred(spark, d), "y", "q"), ["threshold", "precision", "recall"])


# splits


def _greedy_sql(groups: str, k: int) -> str:
    """Table expressions up to ``dealt`` (g, fold): ``groups`` gives (g, n, i) in order from 1; each to the smallest fold."""
    loads = ", ".join("0" for _ in range(k))
    return f"""WITH RECURSIVE o AS ({groups}), w AS (SELECT 0::BIGINT AS i, [{loads}]::BIGINT[] AS loads, -1::BIGINT AS fold
    UNION ALL SELECT o.i, list_transform(range(0, {k}), lambda j: loads[j + 1] + CASE WHEN j + 1 = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END), list_position(loads, list_min(loads)) - 1 FROM w JOIN o ON o.i = w.i + 1),
    dealt AS (SELECT o.g, w.fold FROM w JOIN o USING (i))"""


SQL["group_kfold_sizes"] = _greedy_sql("SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i FROM customer GROUP BY 1", 4) + " SELECT fold::INT AS fold, count(*) AS n, count(DISTINCT c_nationkey) AS groups FROM customer JOIN dealt ON g = c_nationkey GROUP BY fold"
SQL["stratified_group_kfold_sizes"] = _greedy_sql("SELECT g, n, row_number() OVER (ORDER BY main, n DESC, g) AS i FROM (SELECT c_nationkey AS g, count(*) AS n, CASE WHEN count(*) FILTER (c_acctbal > 0) > count(*) FILTER (c_acctbal <= 0) THEN 1 ELSE 0 END AS main FROM customer GROUP BY 1)", 4) + " SELECT fold::INT AS fold, count(*) AS n FROM customer JOIN dealt ON g = c_nationkey GROUP BY fold"


@register("repeated_stratified_kfold_sizes", "SELECT r::INT AS repeat, f::INT AS fold, toxic, ((n - f + 2) // 3)::BIGINT AS n FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), (VALUES (0), (1)) v(r), (VALUES (0), (1), (2)) w(f)")
def repeated_stratified_kfold_sizes(spark, d):
    return S.repeated_stratified_kfold(table(spark, d, "labels").select("doc_id", "toxic"), 3, 2, "toxic", ["doc_id"]).groupBy("repeat", "fold", "toxic").agg(F.count("*").alias("n"))


@register("leave_two_out", "SELECT a.n_nationkey::INT AS a, b.n_nationkey::INT AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def leave_two_out(spark, d):
    return spark.createDataFrame(S.leave_p_out(table(spark, d, "nation").count(), 2), "a int, b int")


@register("stratified_split", "SELECT toxic, doc_id, i <= ceil(n * 0.2 - 1e-9) AS is_test FROM (SELECT toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels)")
def stratified_split(spark, d):
    a, b = S.train_test_split(table(spark, d, "labels").select("toxic", "doc_id"), 0.2, ["doc_id"], "toxic")
    return a.withColumn("is_test", F.lit(False)).unionByName(b.withColumn("is_test", F.lit(True)))


@register("cv_summary", f"WITH {fold_scores(3, [0.0])}, m AS (SELECT avg(r2) AS m, stddev_samp(r2) AS s FROM scores) SELECT round(m, 6) AS mean, round(s, 6) AS std, round(m - 4.302652729696142 * s / sqrt(3), 5) AS low, round(m + 4.302652729696142 * s / sqrt(3), 5) AS high FROM m")
def cv_summary(spark, d):
    r = H.cross_val_score(L.LinearRegression, _line(spark, d), ["l_quantity"], "l_extendedprice", ["id"], folds=3)
    return rounded(rounded(_row(spark, mean=r.mean, std=r.std, low=r.interval()[0], high=r.interval()[1]), ["mean", "std"]), ["low", "high"], 5)


@register("validation_curve", f"WITH {fold_scores(3, [1.0, 1e5, 1e7])} SELECT alpha, round(avg(r2), 6) AS r2 FROM scores GROUP BY alpha")
def validation_curve(spark, d):
    found = H.validation_curve(L.Ridge, _line(spark, d), ["l_quantity"], "l_extendedprice", ["id"], "alpha", [1.0, 1e5, 1e7], folds=3)
    return rounded(spark.createDataFrame([(a, r.mean) for a, r in found.items()], "alpha double, r2 double"), ["r2"])


_OUTER = _FOLDS.format(k=2)
_INNER = _FOLDS.format(k=2).replace("i ", "j ").replace("(i -", "(j -").replace("n ", "m ").replace("(n /", "(m /")


@register("nested_cv", f"""WITH b AS (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), f AS (SELECT *, {_OUTER} AS fold FROM b),
    t AS (SELECT o.fold AS outside, x, y, row_number() OVER (PARTITION BY o.fold ORDER BY id) - 1 AS j, count(*) OVER (PARTITION BY o.fold) AS m FROM (SELECT DISTINCT fold FROM f) o JOIN f ON f.fold <> o.fold), g AS (SELECT *, {_INNER} AS inside FROM t),
    c AS (SELECT k.outside, k.inside, alpha, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + alpha) AS s, avg(x) AS mx, avg(y) AS my FROM (SELECT DISTINCT outside, inside FROM g) k JOIN g ON g.outside = k.outside AND g.inside <> k.inside, (VALUES (1.0::DOUBLE), (1e6)) v(alpha) GROUP BY k.outside, k.inside, alpha),
    e AS (SELECT g.outside, g.inside, alpha, 1 - sum((y - my - s * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM g JOIN c USING (outside, inside) GROUP BY ALL), h AS (SELECT outside, alpha, avg(r2) AS r2 FROM e GROUP BY ALL),
    w AS (SELECT outside, arg_max(alpha, r2) AS alpha, max(r2) AS r2 FROM h GROUP BY outside), q AS (SELECT w.outside, any_value(w.r2) AS inner_r2, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + any_value(alpha)) AS s, avg(x) AS mx, avg(y) AS my FROM w JOIN f ON f.fold <> w.outside GROUP BY w.outside),
    z AS (SELECT q.outside, any_value(inner_r2) AS b, 1 - sum((y - my - s * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS a FROM q JOIN f ON f.fold = q.outside GROUP BY q.outside) SELECT round(avg(a), 6) AS "outer", round(avg(b), 6) AS "inner" FROM z""")
def nested_cv(spark, d):
    found = H.nested_cv(L.Ridge, {"alpha": [1.0, 1e6]}, table(spark, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"], outer=2, inner=2)
    return rounded(_row(spark, outer=found["outer"], inner=found["inner"]), ["outer", "inner"])


# selection

_SCORES = "SELECT * FROM (SELECT abs(corr(l_quantity, l_extendedprice)) AS l_quantity, abs(corr(l_discount, l_extendedprice)) AS l_discount, abs(corr(l_tax, l_extendedprice)) AS l_tax FROM lineitem) UNPIVOT (v FOR feature IN (l_quantity, l_discount, l_tax))"


def _importances(spark, d, columns):
    found = table(spark, d, "lineitem").agg(*[F.abs(F.corr(c, "l_extendedprice")) for c in columns]).first()
    return dict(zip(columns, found))


@register("select_from_importances", f"WITH s AS ({_SCORES}) SELECT feature FROM s WHERE v >= (SELECT avg(v) FROM s)")
def select_from_importances(spark, d):
    return spark.createDataFrame([(c,) for c in K.select_from_importances(_importances(spark, d, _THREE))], "feature string")


@register("recursive_elimination", f"SELECT feature, row_number() OVER (ORDER BY v DESC)::INT AS rank FROM ({_SCORES})")
def recursive_elimination(spark, d):
    _, rank = K.recursive_elimination(lambda left: _importances(spark, d, left), _THREE, 1)
    return spark.createDataFrame(list(rank.items()), "feature string, rank int")


SQL["select_k_best"] = """WITH s AS (SELECT * FROM (SELECT l_returnflag AS y, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (x FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))),
    g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY ALL), t AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g GROUP BY feature)
    SELECT feature, (SELECT count(*) FROM lineitem) AS n FROM (SELECT feature, row_number() OVER (ORDER BY (b / (k - 1)) / (w / (n - k)) DESC) AS r FROM t) WHERE r <= 2"""


# studies: grids make the trials known


def _study(points: int = 3):
    space = {"x": H.Param(0.0, 1.0), "k": H.Param(1, 9, "int")}
    study = H.Study(space, sampler=H.GridSampler(points))
    study.optimise(lambda p: -((p["x"] - 0.3) ** 2) - (p["k"] - 6) ** 2 / 100, points * points)
    return study


def _grid_sql(points: int) -> str:
    return f"SELECT (a * {points} + b)::INT AS trial, a / {points - 1}.0::DOUBLE AS x, floor(1 + 8 * b / {points - 1}.0::DOUBLE + 0.5)::INT AS k FROM (SELECT unnest(range({points})) AS a), (SELECT unnest(range({points})) AS b)"


@register("study_grid", f"SELECT trial, round(-((x - 0.3) ** 2) - (k - 6) ** 2 / 100, 6) AS value, 'complete' AS state FROM ({_grid_sql(3)})")
def study_grid(spark, d):
    return rounded(_study().table(spark).select("trial", "value", "state"), ["value"])


@register("search_space", f"SELECT trial, x, k FROM ({_grid_sql(4)})")
def search_space(spark, d):
    space = {"x": H.Param(0.0, 1.0), "k": H.Param(1, 9, "int")}
    return spark.createDataFrame([(i, p["x"], p["k"]) for i, p in enumerate(H.grid_points(space, 4))], "trial int, x double, k int")


@register("study_importance", f"WITH g AS (SELECT x, (k - 1) / 8.0::DOUBLE AS u, -((x - 0.3) ** 2) - (k - 6) ** 2 / 100 AS v FROM ({_grid_sql(4)})), c AS (SELECT abs(corr(x, v)) AS a, abs(corr(u, v)) AS b FROM g) SELECT 'x' AS param, round(a / (a + b), 6) AS importance FROM c UNION ALL SELECT 'k', round(b / (a + b), 6) FROM c")
def study_importance(spark, d):
    return rounded(spark.createDataFrame(list(_study(4).importance().items()), "param string, importance double"), ["importance"])


def _curves():
    """Twelve trials with four intermediate values each."""
    study = H.Study({"x": H.Param(0.0, 1.0)}, sampler=H.GridSampler(12))
    for i in range(12):
        trial = study.ask()
        trial.intermediate = [float((i * 7 + s * 3) % 13 + s) for s in range(4)]
    return study


_CURVES = "SELECT i::INT AS trial, s, ((i * 7 + s * 3) % 13 + s)::DOUBLE AS v FROM (SELECT unnest(range(12)) AS i), (SELECT unnest(range(4)) AS s)"


@register("median_pruner", f"WITH c AS ({_CURVES}), l AS (SELECT * FROM c WHERE s = 3) SELECT a.trial, a.v < (SELECT list(b.v ORDER BY b.v DESC)[6] FROM l b WHERE b.trial <> a.trial) AS pruned FROM l a")
def median_pruner(spark, d):
    study = _curves()
    return spark.createDataFrame([(i, H.MedianPruner(5).should_prune(study, t)) for i, t in enumerate(study.trials)], "trial int, pruned boolean")


@register("asha", f"WITH c AS ({_CURVES}), l AS (SELECT * FROM c WHERE s = 3) SELECT trial, v < (SELECT list(v ORDER BY v DESC)[6] FROM l) AS pruned FROM l")
def asha(spark, d):
    study = _curves()
    return spark.createDataFrame([(i, H.ASHA(1, 2).should_prune(study, t)) for i, t in enumerate(study.trials)], "trial int, pruned boolean")


@register("hyperband_rounds", """WITH RECURSIVE b AS (SELECT s, ceil(3.0::DOUBLE / (s + 1) * 3 ** s)::BIGINT AS n FROM (VALUES (0), (1), (2)) v(s)), r AS (SELECT s, 0 AS i, n FROM b UNION ALL SELECT s, i + 1, greatest(1, n // 3) FROM r WHERE i < s),
    d AS (SELECT s, i, n - coalesce(lead(n) OVER (PARTITION BY s ORDER BY i), 0) AS n FROM r) SELECT (i + 1)::INT AS rounds, sum(n)::BIGINT AS trials FROM d GROUP BY i""")
def hyperband_rounds(spark, d):
    study = H.hyperband({"x": H.Param(0.0, 1.0)}, lambda p, r: p["x"] * r, 9)
    made = spark.createDataFrame([(len(t.intermediate),) for t in study.trials], "rounds int")
    return made.groupBy("rounds").agg(F.count("*").alias("trials"))


@register("bandit_ucb", """WITH RECURSIVE w AS (SELECT 3 AS t, 1 AS a, 1 AS b, 1 AS c UNION ALL SELECT t + 1, a + (k = 0)::INT, b + (k = 1)::INT, c + (k = 2)::INT FROM
    (SELECT *, CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS k FROM (SELECT *, 0.2 + sqrt(2 * ln(t) / a) AS x, 0.5 + sqrt(2 * ln(t) / b) AS y, 0.8 + sqrt(2 * ln(t) / c) AS z FROM w)) WHERE t < 60)
    SELECT arm, n::BIGINT AS n FROM w, LATERAL (VALUES ('a', a), ('b', b), ('c', c)) v(arm, n) WHERE t = 60""")
def bandit_ucb(spark, d):
    bandit, reward = H.Bandit(["a", "b", "c"]), {"a": 0.2, "b": 0.5, "c": 0.8}
    for _ in range(60):
        arm = bandit.select()
        bandit.update(arm, reward[arm])
    return spark.createDataFrame([(a, len(v)) for a, v in bandit.values.items()], "arm string, n long")


@register("warm_start", """WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS m FROM events GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS n, avg(value) AS m FROM events)
    SELECT event_type AS nearest FROM g, t ORDER BY (ln(1 + g.n) - ln(1 + t.n)) ** 2 + (ln(1 + abs(g.m)) - ln(1 + abs(t.m))) ** 2 LIMIT 2""")
def warm_start(spark, d):
    df = table(spark, d, "events")
    history = [({"n": float(r[1]), "m": r[2]}, {"type": r[0]}) for r in df.groupBy("event_type").agg(F.count("*"), F.avg("value")).collect()]
    n, m = df.agg(F.count("*"), F.avg("value")).first()
    return spark.createDataFrame([(p["type"],) for p in H.warm_start(history, {"n": float(n), "m": m}, 2)], "nearest string")


_PROFILE = """l AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, (l_extendedprice > 40000)::INT::DOUBLE AS y FROM lineitem), u AS (SELECT * FROM (SELECT a, b, c FROM l) UNPIVOT (v FOR f IN (a, b, c))), m AS (SELECT f, avg(v) AS m FROM u GROUP BY f),
    k AS (SELECT f, avg((v - m) ** 3) / avg((v - m) ** 2) ** 1.5 AS s, avg((v - m) ** 4) / avg((v - m) ** 2) ** 2 - 3 AS k, avg((v = 0)::INT) AS z, count(DISTINCT v) AS u FROM u JOIN m USING (f) GROUP BY f),
    q AS (SELECT avg(s) AS skewness, avg(k) AS kurtosis, avg(z) AS sparsity, avg(u) AS distinct_ FROM k), y AS (SELECT count(*)::DOUBLE AS n, avg(y) AS p, (abs(corr(a, y)) + abs(corr(b, y)) + abs(corr(c, y))) / 3 AS r FROM l)"""
SQL["meta_features"] = f"""WITH {_PROFILE} SELECT feature, round(value, 5) + 0.0 AS value FROM q, y, LATERAL (VALUES ('n', n), ('p', 3.0::DOUBLE), ('n_over_p', n / 3), ('classes', 2), ('majority', greatest(y.p, 1 - y.p)), ('minority', least(y.p, 1 - y.p)), ('entropy', -y.p * ln(y.p) - (1 - y.p) * ln(1 - y.p)),
    ('skewness', skewness), ('kurtosis', kurtosis), ('missing', 0), ('sparsity', sparsity), ('distinct', distinct_), ('correlation', r)) v(feature, value)"""
SQL["recommend"] = f"""WITH {_PROFILE}, r AS (SELECT model, score::DOUBLE AS score, reason, row_number() OVER (ORDER BY score DESC, o) AS k FROM q, y, LATERAL (VALUES (1, 'hist_gradient_boosting', CASE WHEN n >= 1000 THEN 0.9 ELSE 0.6 END, 'strong on tables of some size'), (2, 'random_forest', CASE WHEN n >= 200 THEN 0.8 ELSE 0.65 END, 'robust with few settings'),
    (3, 'linear', CASE WHEN n < 150 THEN 0.8 ELSE 0.6 END, 'few rows for each column favour linear models'), (4, 'logistic', 0.7, 'shrinkage helps with many columns'), (5, 'gaussian_nb', CASE WHEN r < 0.3 THEN 0.6 ELSE 0.5 END, 'cheap baseline'), (6, 'knn', CASE WHEN n < 10000 THEN 0.6 ELSE 0.3 END, 'local structure in few dimensions'),
    (7, 'multinomial_nb', CASE WHEN sparsity > 0.5 THEN 0.7 ELSE 0.4 END, 'made for sparse columns')) v(o, model, score, reason)) SELECT model, score, reason FROM r WHERE k <= 5"""


@register("preprocessing_steps", f"WITH {_PROFILE} SELECT CASE WHEN abs(skewness) > 2 THEN 'power_transformer,' ELSE '' END || CASE WHEN sparsity > 0.5 THEN 'max_abs_scaler' WHEN kurtosis > 10 THEN 'robust_scaler' ELSE 'standard_scaler' END AS steps FROM q")
def preprocessing_steps(spark, d):
    return spark.createDataFrame([(",".join(H.preprocessing_steps(H.meta_features(_line(spark, d), _THREE, "big"), ["continuous"])),)], "steps string")


# explanation, composition, decomposition, text


@register("kernel_shap", "SELECT round(avg(2 * n_nationkey - 3 * n_regionkey + 1), 6) AS base, round(2 * (10 - avg(n_nationkey)), 6) AS nation, round(-3 * (2 - avg(n_regionkey)), 6) AS region FROM nation")
def kernel_shap(spark, d):
    rows = np.array([[float(r[0]), float(r[1])] for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()])
    base, phi = X.kernel_shap(lambda x: 2 * x[:, 0] - 3 * x[:, 1] + 1, rows, np.array([10.0, 2.0]))
    return rounded(_row(spark, base=base, nation=phi[0], region=phi[1]), ["base", "nation", "region"])


@register("make_helpers", "WITH a AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem) SELECT round((l_quantity - m) / s, 6) AS standardscaler__l_quantity, round((l_tax - lo) / (hi - lo), 6) AS minmaxscaler__l_tax FROM lineitem, a")
def make_helpers(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_tax")
    made = E.make_column_transformer((P.StandardScaler(), ["l_quantity"]), (P.MinMaxScaler(), ["l_tax"]))
    return rounded(made.fit(df).transform(df), ["standardscaler__l_quantity", "minmaxscaler__l_tax"])


@register("incremental_pca", "WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS b, covar_samp(l_quantity, l_discount * 100) AS c FROM lineitem) SELECT round((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c), 6) AS first, round((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c), 6) AS second FROM c")
def incremental_pca(spark, d):
    df, m = _line(spark, d).withColumn("e", F.col("l_discount") * 100), D.PCA()
    for part in range(3):
        m.partial_fit(df.filter(F.col("l_orderkey") % 3 == part), ["l_quantity", "e"])
    return rounded(_row(spark, first=m.explained_variance[0], second=m.explained_variance[1]), ["first", "second"])


_LONG = "f AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@register("pca_spectrum", f"WITH {_LONG}, m AS (SELECT k, avg(x) AS m FROM f GROUP BY k), z AS (SELECT i, k, x - m AS x FROM f JOIN m USING (k)), c AS (SELECT a.k, b.k AS l, sum(a.x * b.x) / (count(*) - 1) AS c FROM z a JOIN z b USING (i) GROUP BY a.k, b.k) SELECT round(sum(c) FILTER (k = l), 6) AS trace, round(sum(c * c), 6) AS squares FROM c")
def pca_spectrum(spark, d):
    m = D.PCA().fit(_flat(spark, d), [f"x{i}" for i in range(64)])
    return rounded(_row(spark, trace=m.explained_variance.sum(), squares=(m.explained_variance**2).sum()), ["trace", "squares"])


@register("svd_spectrum", f"WITH {_LONG}, c AS (SELECT a.k, b.k AS l, sum(a.x * b.x) AS c FROM f a JOIN f b USING (i) GROUP BY a.k, b.k) SELECT round(sum(c) FILTER (k = l), 4) AS squares, round(sum(c * c), 3) AS fourths FROM c")
def svd_spectrum(spark, d):
    s = D.TruncatedSVD(64).fit(_flat(spark, d), [f"x{i}" for i in range(64)]).singular_values
    return rounded(rounded(_row(spark, squares=(s**2).sum(), fourths=(s**4).sum()), ["squares"], 4), ["fourths"], 3)


_CLASSED = f"""WITH {_TOKENS}, s AS (SELECT class, term, sum(n)::DOUBLE AS c FROM c JOIN y USING (doc) GROUP BY ALL), g AS (SELECT k.class, v.term, coalesce(s.c, 0) AS c FROM k CROSS JOIN v LEFT JOIN s ON s.class = k.class AND s.term = v.term),
    p AS (SELECT class, term, ln((c + 1) / (sum(c) OVER (PARTITION BY class) + count(*) OVER (PARTITION BY class))) AS lp FROM g), e AS (SELECT y.doc, k.class, ln(k.d / (SELECT sum(d) FROM k)) + coalesce(any_value(t.s), 0) AS s FROM y CROSS JOIN k LEFT JOIN (SELECT doc, class, sum(n * lp) AS s FROM c JOIN p USING (term) GROUP BY ALL) t ON t.doc = y.doc AND t.class = k.class GROUP BY y.doc, k.class, k.d)
    SELECT doc, arg_max(class, {{'s': s, 'c': class}}) AS prediction FROM e GROUP BY doc"""
SQL["multinomial_nb_predict"] = _CLASSED.replace("FROM y CROSS JOIN k", "FROM (SELECT DISTINCT doc FROM c) y CROSS JOIN k")


@register("text_pipeline", _CLASSED)
def text_pipeline(spark, d):
    docs = table(spark, d, "documents")
    return E.TextPipeline(CountVectorizer(), B.TermNB()).fit(docs, "lang").predict(docs)


SQL["qda_predict"] = """WITH x AS (SELECT o_orderkey, o_orderstatus AS y, o_totalprice AS v, o_custkey::DOUBLE AS w FROM orders),
    m AS (SELECT y, ln(count(*)::DOUBLE / (SELECT count(*) FROM x)) AS p, avg(v) AS a, avg(w) AS b, var_samp(v) AS s, var_samp(w) AS t, covar_samp(v, w) AS c FROM x GROUP BY y),
    l AS (SELECT o_orderkey, m.y, p - 0.5 * ln(s * t - c * c) - 0.5 * (t * (v - a) ** 2 - 2 * c * (v - a) * (w - b) + s * (w - b) ** 2) / (s * t - c * c) AS l FROM x, m) SELECT prediction, count(*) AS count FROM (SELECT o_orderkey, arg_max(y, l) AS prediction FROM l GROUP BY 1) GROUP BY 1"""
SQL["drift"] = """WITH r AS (SELECT value AS x FROM events WHERE event_id % 2 = 0), c AS (SELECT value AS x FROM events WHERE event_id % 2 = 1), e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM r),
    a AS (SELECT len(list_filter(q, lambda z: z <= x)) AS b, count(*)::DOUBLE AS p FROM r, e GROUP BY 1), z AS (SELECT len(list_filter(q, lambda z: z <= x)) AS b, count(*)::DOUBLE AS p FROM c, e GROUP BY 1),
    j AS (SELECT greatest(coalesce(a.p, 0) / (SELECT count(*) FROM r), 1e-6) AS p, greatest(coalesce(z.p, 0) / (SELECT count(*) FROM c), 1e-6) AS q FROM a FULL JOIN z USING (b))
    SELECT round(sum((p - q) * ln(p / q)), 6) AS psi, round(((SELECT avg(x) FROM c) - (SELECT avg(x) FROM r)) / (SELECT stddev_pop(x) FROM r), 6) AS mean_shift FROM j"""


# searches whose drawings don't matter to the result


@register("learning_curve", f"WITH {fold_scores(3, [0.0])} SELECT 1.0::DOUBLE AS size, round(avg(r2), 6) AS r2 FROM scores")
def learning_curve(spark, d):
    found = H.learning_curve(L.LinearRegression, _line(spark, d), ["l_quantity"], "l_extendedprice", ["id"], sizes=(1.0,), folds=3)
    return rounded(spark.createDataFrame([(s, r.mean) for s, r in found.items()], "size double, r2 double"), ["r2"])


@register("randomized_search", f"WITH {fold_scores(2, [1e6])} SELECT t::INT AS trial, round(avg(r2), 6) AS r2 FROM scores, (VALUES (0), (1)) v(t) GROUP BY t")
def randomized_search(spark, d):
    study = H.randomized_search(L.Ridge, {"alpha": H.Param(choices=(1e6,))}, 2, _line(spark, d), ["l_quantity"], "l_extendedprice", ["id"], folds=2)
    return rounded(spark.createDataFrame([(i, t.value) for i, t in enumerate(study.trials)], "trial int, r2 double"), ["r2"])


@register("samplers", "SELECT sampler, 24::BIGINT AS trials, true AS within, true AS near_best FROM (VALUES ('random'), ('tpe'), ('bayes'), ('grid')) v(sampler)")
def samplers(spark, d):
    space, rows = {"x": H.Param(0.0, 1.0), "k": H.Param(1, 9, "int")}, []
    for name, sampler in (("random", H.RandomSampler()), ("tpe", H.TPESampler()), ("bayes", H.BayesSampler()), ("grid", H.GridSampler(4))):
        study = H.Study(space, sampler=sampler)
        best = study.optimise(lambda p: -((p["x"] - 0.3) ** 2) - (p["k"] - 6) ** 2 / 100, 24)
        inside = all(0 <= t.params["x"] <= 1 and t.params["k"] in range(1, 10) for t in study.trials)
        rows.append((name, len(study.trials), inside, best.value == max(t.value for t in study.trials) and best.value > -0.1))
    return spark.createDataFrame(rows, "sampler string, trials long, within boolean, near_best boolean")


@register("elbow", "WITH i AS (SELECT k, 1000.0::DOUBLE / (k * k) AS v FROM (SELECT unnest(range(1, 9)) AS k)) SELECT arg_max(k, 1000 + (1000 / 64.0::DOUBLE - 1000) * (k - 1) / 7.0::DOUBLE - v)::INT AS k FROM i")
def elbow_query(spark, d):
    return spark.createDataFrame([(C.elbow({k: 1000.0 / (k * k) for k in range(1, 9)}),)], "k int")


@register("hopkins", "SELECT true AS clustered, true AS bounded")
def hopkins(spark, d):
    h = M.hopkins(table(spark, d, "embeddings"), "vec_id", "embedding")
    return spark.createDataFrame([(h > 0.5, 0 <= h <= 1)], "clustered boolean, bounded boolean")


_KERNELS = {
    "rbf": (G.Kernel("rbf", 10.0), "exp(-1 * pow(a - b, 2) / 200)"),
    "matern_half": (G.Kernel("matern", 5.0, 0.5), "exp(-abs(a - b) / 5)"),
    "matern_three_halves": (G.Kernel("matern", 5.0, 1.5), "(1 + sqrt(3) * abs(a - b) / 5) * exp(-sqrt(3) * abs(a - b) / 5)"),
    "matern_five_halves": (G.Kernel("matern", 5.0, 2.5), "(1 + sqrt(5) * abs(a - b) / 5 + 5 * (a - b) ** 2 / 75) * exp(-sqrt(5) * abs(a - b) / 5)"),
    "linear": (G.Kernel("linear", 4.0), "a * b / 4"),
    "poly": (G.Kernel("poly", 100.0, degree=3, coef=1.0), "(a * b / 100 + 1) ** 3"),
}


@register("gp_kernels", "WITH n AS (SELECT n_nationkey::DOUBLE AS k FROM nation), p AS (SELECT x.k AS a, y.k AS b FROM n x, n y) " + " UNION ALL ".join(f"SELECT '{k}' AS kernel, round(sum({sql}), 6) AS total, round(max({sql}), 6) AS most FROM p" for k, (_, sql) in _KERNELS.items()))
def gp_kernels(spark, d):
    x = np.array([[float(r[0])] for r in table(spark, d, "nation").select("n_nationkey").collect()])
    found = [(name, float(kernel(x, x).sum()), float(kernel(x, x).max())) for name, (kernel, _) in _KERNELS.items()]
    return rounded(spark.createDataFrame(found, "kernel string, total double, most double"), ["total", "most"])


_CENTILES = ", ".join(str(i / 100) for i in range(101))


@register("dbscan_eps", f"""WITH {_NEAR}, k AS (SELECT d FROM n WHERE r = 5), q AS (SELECT unnest(range(101)) AS i, unnest(quantile_cont(d, [{_CENTILES}])) AS q FROM k)
    SELECT round(arg_max(q, low + (high - low) * i / 100 - q), 6) AS eps FROM q, (SELECT min(q) AS low, max(q) AS high FROM q)""")
def dbscan_eps(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(_row(spark, eps=C.optimal_eps(v, 5)), ["eps"])
