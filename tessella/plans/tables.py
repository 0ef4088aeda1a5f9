"""Queries over sources, schemas, preprocessing and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.frame import Dataset, FeatureSpec, describe, infer_schema, validate
from tessella.operators import preprocessing as P
from tessella.operators import splits as S
from tessella.operators import text as X
from tessella.plans.registry import register, rounded, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber"]


def _line(spark, d):
    return table(spark, d, "lineitem").select(*KEY, *LINE)


def _keyed(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return rounded(df.select(*KEY, *columns), columns, digits)


@register(
    "describe_lineitem",
    """WITH s AS (SELECT * FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))
    SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median, 0::BIGINT AS n_missing FROM s GROUP BY feature""",
)
def describe_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(describe(table(spark, d, "lineitem"), LINE), ["mean", "std", "median"])


@register(
    "schema_inference",
    """WITH s AS (SELECT * FROM (SELECT l_quantity, l_extendedprice, l_discount, l_linenumber::DOUBLE AS l_linenumber FROM lineitem) UNPIVOT (x FOR feature IN (l_quantity, l_extendedprice, l_discount, l_linenumber))),
    g AS (SELECT feature, min(x) AS min, max(x) AS max, count(DISTINCT x) AS n_unique, count(*) FILTER (x <> floor(x)) AS b FROM s GROUP BY feature)
    SELECT feature, CASE WHEN n_unique = 2 AND min = 0 AND max = 1 THEN 'binary' WHEN b = 0 AND n_unique <= 20 THEN 'categorical' WHEN b = 0 THEN 'integer' ELSE 'continuous' END AS kind, min, max, n_unique, false AS allow_missing FROM g""",
)
def schema_inference(spark, d):
    return infer_schema(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])


@register(
    "schema_validation",
    """SELECT o_orderkey, 'o_totalprice' AS feature, 'above_maximum' AS issue, 'warning' AS severity FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT o_orderkey, 'o_totalprice', 'not_integer', 'warning' FROM orders WHERE o_totalprice <> floor(o_totalprice)
    UNION ALL SELECT o_orderkey, 'o_custkey', 'below_minimum', 'warning' FROM orders WHERE o_custkey < 10""",
)
def schema_validation(spark, d):
    specs = [FeatureSpec("o_totalprice", "integer", True, None, 300000.0), FeatureSpec("o_custkey", "integer", False, 10.0)]
    return validate(table(spark, d, "orders"), specs, "o_orderkey")


@register("class_counts", "SELECT toxic::BIGINT AS class, count(*) AS n FROM labels GROUP BY 1")
def class_counts(spark, d):
    return Dataset.of(table(spark, d, "labels"), "toxic", ["quality"]).class_counts()


@register("batches_events", "SELECT batch, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT floor((row_number() OVER (ORDER BY event_id) - 1) / 256)::BIGINT AS batch, value FROM events) GROUP BY 1")
def batches_events(spark, d):
    data = Dataset.of(table(spark, d, "events").select("event_id", "value"), "value", ["value"], ["event_id"])
    return rounded(data.batches(256).groupBy("batch").agg(F.count("*").alias("n"), F.sum("value").alias("total")), ["total"], 4)


def _scaler(name, scaler, sql):
    @register(name, sql)
    def query(spark, d):
        return _keyed(scaler().fit_transform(_line(spark, d), LINE), LINE)


def _each(expression: str, stats: str) -> str:
    made = ", ".join(f"round({expression.format(c=c)}, 6) AS {c}" for c in LINE)
    return f"WITH a AS (SELECT {', '.join(stats.format(c=c) for c in LINE)} FROM lineitem) SELECT l_orderkey, l_linenumber, {made} FROM lineitem, a"


_scaler("standard_scaler_lineitem", P.StandardScaler, _each("({c} - m_{c}) / s_{c}", "avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"))
_scaler("minmax_scaler_lineitem", P.MinMaxScaler, _each("({c} - a_{c}) / (b_{c} - a_{c})", "min({c}) AS a_{c}, max({c}) AS b_{c}"))
_scaler("maxabs_scaler_lineitem", P.MaxAbsScaler, _each("{c} / m_{c}", "max(abs({c})) AS m_{c}"))
_scaler("robust_scaler_lineitem", P.RobustScaler, _each("({c} - m_{c}) / (b_{c} - a_{c})", "quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}"))

_SIZES = {"l1": " + ".join(f"abs({c})" for c in LINE), "l2": "sqrt(" + " + ".join(f"{c} * {c}" for c in LINE) + ")", "max": "greatest(" + ", ".join(f"abs({c})" for c in LINE) + ")"}
for _norm, _size in _SIZES.items():
    _scaler(f"normalizer_{_norm}", lambda n=_norm: P.Normalizer(n), f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({c} / ({_size}), 6) AS {c}' for c in LINE)} FROM lineitem")


@register("binarizer", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS l_quantity FROM lineitem")
def binarizer(spark, d):
    return P.Binarizer(25.0).fit_transform(_line(spark, d), ["l_quantity"]).select(*KEY, "l_quantity")


@register("yeo_johnson_fixed", "SELECT event_id, round(CASE WHEN value >= 0 THEN (pow(value + 1, 0.3) - 1) / 0.3 ELSE -(pow(1 - value, 1.7) - 1) / 1.7 END, 6) AS value FROM events")
def yeo_johnson_fixed(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(P.PowerTransformer(standardize=False, lambdas={"value": 0.3}).fit_transform(df, ["value"]), ["value"])


@register("power_transform_events")
def power_transform_events(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(P.PowerTransformer().fit_transform(df, ["value"]), ["value"], 3)


@register(
    "quantile_uniform_transform",
    """WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM orders)
    SELECT o_orderkey, round(CASE WHEN o_totalprice <= q[1] THEN 1e-7 WHEN o_totalprice >= q[5] THEN 1 - 1e-7
      WHEN o_totalprice <= q[2] THEN (o_totalprice - q[1]) / (q[2] - q[1]) / 4 WHEN o_totalprice <= q[3] THEN (1 + (o_totalprice - q[2]) / (q[3] - q[2])) / 4
      WHEN o_totalprice <= q[4] THEN (2 + (o_totalprice - q[3]) / (q[4] - q[3])) / 4 ELSE (3 + (o_totalprice - q[4]) / (q[5] - q[4])) / 4 END, 6) AS o_totalprice FROM orders, q""",
)
def quantile_uniform_transform(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(P.QuantileTransformer(n_quantiles=5).fit_transform(df, ["o_totalprice"]), ["o_totalprice"])


@register("kbins_uniform", "WITH a AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= b THEN 4 WHEN l_extendedprice >= a + (b - a) * 4 / 5 THEN 4 WHEN l_extendedprice >= a + (b - a) * 3 / 5 THEN 3 WHEN l_extendedprice >= a + (b - a) * 2 / 5 THEN 2 WHEN l_extendedprice >= a + (b - a) * 1 / 5 THEN 1 ELSE 0 END::DOUBLE AS l_extendedprice FROM lineitem, a")
def kbins_uniform(spark, d):
    return P.KBinsDiscretizer(5).fit_transform(_line(spark, d), ["l_extendedprice"]).select(*KEY, "l_extendedprice")


@register("kbins_quantile", "WITH a AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= q[3] THEN 3 WHEN l_extendedprice >= q[2] THEN 2 WHEN l_extendedprice >= q[1] THEN 1 ELSE 0 END::DOUBLE AS l_extendedprice FROM lineitem, a")
def kbins_quantile(spark, d):
    return P.KBinsDiscretizer(4, "quantile").fit_transform(_line(spark, d), ["l_extendedprice"]).select(*KEY, "l_extendedprice")


@register("kbins_kmeans")
def kbins_kmeans(spark, d):
    return P.KBinsDiscretizer(4, "kmeans").fit_transform(_line(spark, d), ["l_extendedprice"]).groupBy("l_extendedprice").count()


@register("polynomial_degree2", "SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS \"1\", l_quantity, l_discount, round(l_quantity * l_quantity, 6) AS \"l_quantity^2\", round(l_quantity * l_discount, 6) AS \"l_quantity l_discount\", round(l_discount * l_discount, 6) AS \"l_discount^2\" FROM lineitem")
def polynomial_degree2(spark, d):
    df = P.PolynomialFeatures(2).fit_transform(table(spark, d, "lineitem").select(*KEY, "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return rounded(df, ["l_quantity^2", "l_quantity l_discount", "l_discount^2"])


_GAPS = "WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000) END AS v FROM orders)"
for _name, _middle in (("mean", "avg(v)"), ("median", "quantile_cont(v, 0.5)"), ("most_frequent", "(SELECT v FROM g WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"), ("constant", "-1")):
    _sql = f"{_GAPS}, m AS (SELECT {'DISTINCT ' if 'SELECT' in _middle or _name == 'constant' else ''}{_middle} AS m FROM g) SELECT o_orderkey, round(coalesce(v, m), 6)::DOUBLE AS v FROM g, m"

    @register(f"impute_{_name}", _sql)
    def impute(spark, d, strategy=_name):
        df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.round(F.col("o_totalprice") / 1000)).alias("v"))
        return rounded(P.SimpleImputer(strategy, fill_value=-1.0).fit_transform(df, ["v"]), ["v"])


@register("knn_imputer_small")
def knn_imputer_small(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return rounded(P.KNNImputer(3).fit(df, ["a", "b"]).transform(df), ["a", "b"], 4)


@register("onehot_returnflag", "SELECT l_orderkey, l_linenumber, l_returnflag, " + ", ".join(f"(l_returnflag = '{v}')::INT::DOUBLE AS l_returnflag_{v}" for v in "ANR") + " FROM lineitem")
def onehot_returnflag(spark, d):
    return P.OneHotEncoder().fit_transform(table(spark, d, "lineitem").select(*KEY, "l_returnflag"), ["l_returnflag"])


@register("ordinal_first_seen", "WITH f AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY min(o_orderkey)) - 1)::DOUBLE AS code FROM orders GROUP BY 1) SELECT o_orderkey, code AS o_orderpriority FROM orders JOIN f USING (o_orderpriority)")
def ordinal_first_seen(spark, d):
    return P.OrdinalEncoder(("o_orderkey",)).fit_transform(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@register("label_encode", "SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS label FROM customer")
def label_encode(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return P.LabelEncoder().fit(df, "c_mktsegment").transform(df)


@register("target_encode", "WITH g AS (SELECT avg(o_totalprice) AS g FROM orders), c AS (SELECT o_orderpriority, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey, round((t + g) / (n + 1), 4) AS o_orderpriority_encoded FROM orders JOIN c USING (o_orderpriority), g")
def target_encode(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(P.TargetEncoder().fit(df, "o_orderpriority", "o_totalprice").transform(df).select("o_orderkey", "o_orderpriority_encoded"), ["o_orderpriority_encoded"], 4)


_FOLDS = "(CASE WHEN i < n % {k} * (n // {k} + 1) THEN i // (n // {k} + 1) ELSE n % {k} + (i - n % {k} * (n // {k} + 1)) // (n // {k}) END)::INT"


@register(
    "target_encode_oof",
    f"""WITH b AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
    f AS (SELECT *, {_FOLDS.format(k=5)} AS fold FROM b)
    SELECT f.o_orderkey, round((coalesce(s.t, 0) + g.g) / (coalesce(s.n, 0) + 1), 4) AS o_orderpriority_encoded FROM f
    JOIN (SELECT a.fold, avg(z.y) AS g FROM (SELECT DISTINCT fold FROM f) a JOIN f z ON z.fold <> a.fold GROUP BY a.fold) g ON g.fold = f.fold
    LEFT JOIN (SELECT a.fold, z.c, sum(z.y) AS t, count(*) AS n FROM (SELECT DISTINCT fold FROM f) a JOIN f z ON z.fold <> a.fold GROUP BY a.fold, z.c) s ON s.fold = f.fold AND s.c = f.c""",
)
def target_encode_oof(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(P.TargetEncoder().fit_transform(df, "o_orderpriority", "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_orderpriority_encoded"), ["o_orderpriority_encoded"], 4)


@register("variance_threshold", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def variance_threshold(spark, d):
    return P.VarianceThreshold(1.0).fit(_line(spark, d), LINE).transform(_line(spark, d))


@register("kfold_ids", f"SELECT o_orderkey, {_FOLDS.format(k=7)} AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")
def kfold_ids(spark, d):
    return S.kfold(table(spark, d, "orders").select("o_orderkey"), 7, ["o_orderkey"])


@register("stratified_kfold_ids", "SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) % 5)::INT AS fold FROM labels")
def stratified_kfold_ids(spark, d):
    return S.stratified_kfold(table(spark, d, "labels").select("doc_id", "toxic"), 5, "toxic", ["doc_id"])


@register("group_kfold_sizes")
def group_kfold_sizes(spark, d):
    return S.group_kfold(table(spark, d, "customer").select("c_custkey", "c_nationkey"), 4, "c_nationkey").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("groups"))


@register("stratified_group_kfold_sizes")
def stratified_group_kfold_sizes(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 0).cast("int").alias("y"))
    return S.stratified_group_kfold(df, 4, "c_nationkey", "y").groupBy("fold").agg(F.count("*").alias("n"))


@register(
    "timeseries_split",
    """WITH b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), s AS (SELECT s FROM (VALUES (0), (1), (2)) v(s))
    SELECT event_id, s::INT AS split, CASE WHEN i < n - (3 - s) * (n // 4) THEN 'train' ELSE 'test' END AS part FROM b, s
    WHERE i < n - (3 - s) * (n // 4) - 10 OR (i >= n - (3 - s) * (n // 4) AND i < n - (2 - s) * (n // 4))""",
)
def timeseries_split(spark, d):
    return S.time_series_split(table(spark, d, "events").select("event_id"), 3, ["event_id"], gap=10)


@register("train_test_tail", "SELECT o_orderkey, i >= n - floor(n * 0.25 + 0.5) AS is_test FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")
def train_test_tail(spark, d):
    data = Dataset.of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_totalprice"], ["o_orderkey"])
    a, b = data.train_test_split(0.25)
    return a.select("o_orderkey", F.lit(False).alias("is_test")).unionByName(b.select("o_orderkey", F.lit(True).alias("is_test")))


@register("leave_one_out_nations", "SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS split FROM nation")
def leave_one_out_nations(spark, d):
    return S.leave_one_out(table(spark, d, "nation").select("n_nationkey"), ["n_nationkey"])


@register("shuffle_split_sizes", "SELECT s::INT AS split, part, CASE WHEN part = 'test' THEN ceil(n * 0.1) ELSE n - ceil(n * 0.1) END::BIGINT AS n FROM (SELECT count(*) AS n FROM orders), (VALUES (0), (1), (2)) v(s), (VALUES ('train'), ('test')) w(part)")
def shuffle_split_sizes(spark, d):
    return S.shuffle_split(table(spark, d, "orders").select("o_orderkey"), 3, ["o_orderkey"]).groupBy("split", "part").agg(F.count("*").alias("n"))


@register("repeated_kfold_sizes", "SELECT r::INT AS repeat, f::INT AS fold, (n // 4 + CASE WHEN f < n % 4 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT count(*) AS n FROM customer), (VALUES (0), (1)) v(r), (VALUES (0), (1), (2), (3)) w(f)")
def repeated_kfold_sizes(spark, d):
    return S.repeated_kfold(table(spark, d, "customer").select("c_custkey"), 4, 2, ["c_custkey"]).groupBy("repeat", "fold").agg(F.count("*").alias("n"))


_TOKENS = r"""t AS (SELECT doc_id AS doc, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda z: strlen(z) >= 2)) AS term FROM documents),
    c AS (SELECT doc, term, count(*) AS n FROM t GROUP BY ALL)"""


@register("count_vectorizer", f"WITH {_TOKENS} SELECT doc, term, n FROM c")
def count_vectorizer(spark, d):
    return X.CountVectorizer().fit_transform(table(spark, d, "documents"))


@register("doc_freq_top_k", f"WITH {_TOKENS} SELECT term, count(*) AS df FROM c GROUP BY term ORDER BY df DESC, term LIMIT 50")
def doc_freq_top_k(spark, d):
    return X.CountVectorizer(max_features=50).fit(table(spark, d, "documents")).vocabulary.select("term", "df")


@register(
    "tfidf_l2",
    f"""WITH {_TOKENS}, f AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
    w AS (SELECT doc, term, n * idf AS v FROM c JOIN f USING (term)) SELECT doc, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc)), 6) AS value FROM w""",
)
def tfidf_l2(spark, d):
    df = table(spark, d, "documents")
    return rounded(X.TfidfVectorizer(X.CountVectorizer(), X.TfidfTransformer()).fit_transform(df), ["value"])


@register(
    "tfidf_sublinear_l1",
    f"""WITH {_TOKENS}, f AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / greatest(1, count(*))) + 1 AS idf FROM c GROUP BY term),
    w AS (SELECT doc, term, (1 + ln(n)) * idf AS v FROM c JOIN f USING (term)) SELECT doc, term, round(v / sum(abs(v)) OVER (PARTITION BY doc), 6) AS value FROM w""",
)
def tfidf_sublinear_l1(spark, d):
    df = table(spark, d, "documents")
    return rounded(X.TfidfVectorizer(X.CountVectorizer(), X.TfidfTransformer("l1", True, False, True)).fit_transform(df), ["value"])


@register(
    "bigrams_binary",
    r"""WITH w AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda z: strlen(z) >= 2 AND z NOT IN ('the', 'of')) AS w FROM documents),
    t AS (SELECT DISTINCT doc, w[i] || ' ' || w[i + 1] AS term FROM (SELECT doc, w, unnest(range(1, len(w))) AS i FROM w))
    SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 5""",
)
def bigrams_binary(spark, d):
    v = X.CountVectorizer(ngram_range=(2, 2), binary=True, stop_words=("the", "of"), min_df=5)
    return v.fit(table(spark, d, "documents")).vocabulary.select("term", "df")


def _matrix(spark, d) -> X.SparseMatrix:
    events = table(spark, d, "events")
    df = events.groupBy(F.col("user_id").alias("row"), F.hour("ts").cast("long").alias("column")).agg(F.sum("value").alias("value"))
    return X.SparseMatrix(df, 1 + events.agg(F.max("user_id")).first()[0], 24)


_MATRIX = "WITH m AS (SELECT user_id AS r, hour(ts::TIMESTAMP)::BIGINT AS c, sum(value) AS v FROM events GROUP BY ALL), k AS (SELECT max(user_id) + 1 AS k FROM events)"


@register("sparse_gram", f"{_MATRIX} SELECT a.c AS row, b.c AS \"column\", round(sum(a.v * b.v), 4) AS value FROM m a JOIN m b USING (r) GROUP BY ALL")
def sparse_gram(spark, d):
    return rounded(_matrix(spark, d).gram().df, ["value"], 4)


@register("sparse_cosine", f"{_MATRIX}, n AS (SELECT r, sqrt(sum(v * v)) AS s FROM m GROUP BY r) SELECT a.r AS query, b.r AS row, round(1 - sum(a.v * b.v) / any_value(x.s * y.s), 6) + 0.0 AS distance FROM m a JOIN m b USING (c) JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r GROUP BY a.r, b.r")
def sparse_cosine(spark, d):
    m = _matrix(spark, d)
    return m.distances(m, "cosine", 6)


for _metric, _sum in {"euclidean": "sqrt(sum((x - y) ** 2))", "manhattan": "sum(abs(x - y))"}.items():

    @register(f"sparse_{_metric}", f"""{_MATRIX}, i AS (SELECT unnest(range((SELECT k FROM k))) AS i),
    f AS (SELECT i.i AS r, c.c, coalesce(m.v, 0) AS v FROM i CROSS JOIN (SELECT unnest(range(24)) AS c) c LEFT JOIN m ON m.r = i.i AND m.c = c.c)
    SELECT query, row, round({_sum}, 4) + 0.0 AS distance FROM (SELECT a.r AS query, b.r AS row, a.v AS x, b.v AS y FROM f a JOIN f b USING (c)) GROUP BY query, row""")
    def sparse_distance(spark, d, metric=_metric):
        m = _matrix(spark, d)
        return m.distances(m, metric, 4)


@register("sparse_column_sums", f"{_MATRIX} SELECT c AS \"column\", round(sum(v), 4) AS sum, round(sum(v) / any_value(k), 6) AS mean, count(*) FILTER (v <> 0) AS nnz FROM m, k GROUP BY c")
def sparse_column_sums(spark, d):
    return rounded(rounded(_matrix(spark, d).column_sums(), ["mean"]), ["sum"], 4)


@register("sparse_vstack", f"{_MATRIX} SELECT r AS row, c AS \"column\", round(v, 6) AS value FROM m UNION ALL SELECT r + k, c, round(v, 6) FROM m, k")
def sparse_vstack(spark, d):
    m = _matrix(spark, d)
    return rounded(m.vstack(m).df, ["value"])


@register("sparse_hstack", f"{_MATRIX} SELECT r AS row, c AS \"column\", round(v, 6) AS value FROM m UNION ALL SELECT r, c + 24, round(v, 6) FROM m")
def sparse_hstack(spark, d):
    m = _matrix(spark, d)
    return rounded(m.hstack(m).df, ["value"])


@register("sparse_eye_diag", f"{_MATRIX} SELECT r AS row, c AS \"column\", round(v * (c + 1), 6) AS value FROM m")
def sparse_eye_diag(spark, d):
    return rounded(_matrix(spark, d).dot(X.sparse_eye(spark, 24)).dot(X.sparse_diag(spark, [i + 1.0 for i in range(24)])).df, ["value"])


@register("sparse_info", f"{_MATRIX} SELECT count(*) AS nnz, round(count(*) / any_value(k * 24.0::DOUBLE), 8) AS density, count(*) / any_value(k * 24.0::DOUBLE) > 0.5 AS dense_is_better FROM m, k")
def sparse_info(spark, d):
    return rounded(_matrix(spark, d).info(), ["density"], 8)


@register("sparse_normalized", f"{_MATRIX} SELECT r AS row, c AS \"column\", round(v / sqrt(sum(v * v) OVER (PARTITION BY r)), 6) AS value FROM m")
def sparse_normalized(spark, d):
    return rounded(_matrix(spark, d).normalize_rows().df, ["value"])
