"""Files, schemas, stored models and streams."""

import math

import pytest
from pyspark.sql import functions as F
from tessella.errors import CorruptModel, InvalidInput
from tessella.frame import Dataset, FeatureSpec, check_finite, drop_constant, infer_schema, resolve_columns, validate
from tessella.operators import linear, preprocessing
from tessella.sources import files, models
from tessella.streaming.moments import MomentSink, drift, moments, stream_moments, variance


def test_csv_and_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nx,name,y\n1,u,2.5\n2,v,NA\n3,w,4.5\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    options = files.CsvOptions(skip_rows=1, null_values=("NA",), columns=("x", "y"))
    rows = files.read_csv(spark, f"{tmp_path}/a.csv", options).collect()
    assert [(r.x, r.y) for r in rows] == [(1, "2.5"), (2, None), (3, "4.5")]
    assert files.read_file(spark, f"{tmp_path}/b.tsv").collect() == [(1, 2)]
    with pytest.raises(InvalidInput):
        files.read_file(spark, "x.zip")
    spark.range(3).withColumn("y", F.col("id") * 2).write.parquet(f"{tmp_path}/c.parquet")
    data = files.load_dataset(spark, f"{tmp_path}/c.parquet")
    assert data.target == "y" and data.features == ("id",) and files.read_parquet(spark, f"{tmp_path}/c.parquet", ["id"]).columns == ["id"]


def test_datasets(spark):
    df = spark.createDataFrame([(i, float(i % 3), "s", None if i == 4 else i / 2) for i in range(60)], "id long, y double, s string, v double")
    data = Dataset.of(df, "y", ["v"], ["id"])
    assert data.infer_task() == "classification" and {r["class"]: r.n for r in data.class_counts().collect()} == {0: 20, 1: 20, 2: 20}
    assert data.describe().first().n_missing == 1
    train, test = data.train_test_split(0.25)
    assert (train.count(), test.count(), test.agg(F.min("id")).first()[0]) == (45, 15, 45)
    with pytest.raises(InvalidInput):
        Dataset.of(df, "y", nulls="error")
    with pytest.raises(InvalidInput):
        Dataset.of(df.select("s"))
    with pytest.raises(InvalidInput):
        check_finite(df, ["v"])
    check_finite(df, ["v"], allow_missing=True)
    assert drop_constant(df.withColumn("c", F.lit(1.0)), ["y", "c"]) == ["y"]
    assert resolve_columns(df, [0, 2]) == ["id", "s"] and resolve_columns(df, [True, False, False, True]) == ["id", "v"] and resolve_columns(df, "remainder", ["id"]) == ["y", "s", "v"]
    kinds = {r.feature: r.kind for r in infer_schema(df.withColumn("b", F.col("id") % 2), ["id", "y", "v", "b"]).collect()}
    assert kinds == {"id": "integer", "y": "categorical", "v": "continuous", "b": "binary"}
    issues = validate(df, [FeatureSpec("v"), FeatureSpec("y", "categorical", categories=(0.0, 1.0))], "id")
    assert {(r.issue, r.severity) for r in issues.collect()} == {("missing", "error"), ("unknown_category", "warning")} and issues.count() == 21
    with pytest.raises(InvalidInput):
        validate(df, [FeatureSpec("v")], "id", "strict")
    with pytest.raises(InvalidInput):
        validate(df, [FeatureSpec("none")], "id")


def test_models_round_trip(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    for model in (linear.Ridge(0.1).fit(df, ["x"], "y"), preprocessing.StandardScaler().fit(df, ["x"])):
        models.save_model(spark, model, f"{tmp_path}/m")
        back = models.load_model(spark, f"{tmp_path}/m")
        assert type(back) is type(model) and vars(back).keys() == vars(model).keys()
        assert models.peek(models.to_bytes(model))["kind"] == type(model).__name__
    assert math.isclose(models.load_model(spark, f"{tmp_path}/m").state["x"]["mean"], 24.5)
    broken = models.to_bytes(model).replace(b"24.5", b"25.5")
    with pytest.raises(CorruptModel):
        models.from_bytes(broken)


def test_streamed_moments_equal_batch(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 17 * 1.5).alias("value"))
    df.repartition(6).write.parquet(f"{tmp_path}/in")
    sink = MomentSink(spark, f"file://{tmp_path}/state", "value", ["k"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    stream_moments(stream, sink, f"file://{tmp_path}/check").awaitTermination()
    assert sink.last == 3
    sink(df.limit(10), 1)  # a replay changes nothing
    got = {r.k: r for r in variance(sink.read()).collect()}
    want = {r.k: r for r in df.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect()}
    assert all(got[k].n == want[k].n and math.isclose(got[k].mean, want[k].m) and math.isclose(got[k].variance, want[k].v) for k in want)
    assert moments(df, "value", ["k"]).count() == 3
    r = drift(df, df.withColumn("value", F.col("value") + 5), "value").first()
    assert r.psi > 0.1 and r.mean_shift > 0.3


def test_generators(spark):
    assert files.make_regression(spark, 10, 3, 1).columns == ["id", "x0", "x1", "x2", "y"]
    assert files.make_moons(spark, 11).count() == files.make_circles(spark, 11).count() == 11
    a, b = (files.make_blobs(spark, 20, seed=3).repartition(n).orderBy("id").collect() for n in (1, 5))
    assert a == b


def test_order_by_ranges_equals_one_window(spark):
    from tessella import frame

    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 5).alias("v")).repartition(6)
    a, b = (frame.in_order(df, ["k"], sums={"s": F.col("v")}, tops={"t": F.col("v") - F.col("k")}, limit=n).orderBy("k").collect() for n in (1000, 10))
    assert a == b and [r["__i"] for r in a] == list(range(500))
    a, b = (frame.with_previous(df, ["k"], "v", "b", limit=n).orderBy("k").collect() for n in (1000, 10))
    assert a == b and a[0].b is None
