"""The thin functions and the command line."""

import json
import math

import pytest
from pyspark.sql import functions as F
from tessella import app
from tessella.errors import InvalidInput
from tessella.sources import models


@pytest.fixture(scope="module")
def lines(spark):
    return spark.range(200).select("id", (F.col("id") % 13 * 1.0).alias("a"), (F.col("id") % 7 * 2.0).alias("b")).withColumn("y", 3 * F.col("a") - F.col("b") + F.pmod(F.xxhash64("id"), F.lit(100)) / 100).cache()


def test_functions(lines):
    m = app.train(lines, "y", "linear", ["a", "b"])
    assert app.evaluate(lines, m, "y", "regression").first().r2 > 0.99
    found = app.compare(lines, "y", ["ridge", "regression_tree"], ["id"], ["a", "b"], 3)
    assert found[0]["model"] == "ridge" and found[0]["mean"] > 0.99
    assert app.diagnose(lines, "y", ["id"], ["a", "b"])["r2"] > 0.99
    assert len(app.recommend(lines.drop("id"), "y")) == 5 and app.info("ridge")["task"] == "regression"
    expression = app.export(m)
    gap = app.predict(lines, m).select(F.max(F.abs(F.expr(expression) - F.col("prediction")))).first()[0]
    assert gap < 1e-9
    assert {r.feature: r.outlier_share for r in app.audit(lines, ["a", "y"]).collect()} == {"a": 0.0, "y": 0.0}
    with pytest.raises(InvalidInput):
        app.train(lines, "y", "none")


def test_command_line(spark, lines, tmp_path, capsys):
    lines.drop("id").write.parquet(f"{tmp_path}/lines.parquet")
    app.main(["train", "--data", f"{tmp_path}/lines.parquet", "--target", "y", "--model", "ridge", "--out", f"{tmp_path}/m"])
    app.main(["predict", "--data", f"{tmp_path}/lines.parquet", "--model", f"{tmp_path}/m", "--out", f"{tmp_path}/p"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 200
    capsys.readouterr()
    app.main(["export", "--model", f"{tmp_path}/m"])
    assert "`a`" in capsys.readouterr().out
    app.main(["info", "--model", "lda"])
    assert json.loads(capsys.readouterr().out)["name"] == "lda"
    assert math.isclose(models.load_model(spark, f"{tmp_path}/m").coefficients[0], 3, rel_tol=0.05)
