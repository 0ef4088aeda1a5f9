"""Thin functions over tables and stored models, and a command line for them.

    python -m tessella.app train --data lines.parquet --target price --model ridge --out model
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import Dataset, infer_schema
from tessella.operators import bayes, linear, metrics, search, stats, trees
from tessella.sources import files, models


@dataclass(frozen=True)
class Card:
    """What a model is for."""

    name: str
    task: str
    distributed: bool
    summary: str


#: Models by name: how to make one, and its card.
CATALOGUE: dict[str, tuple[Callable[..., object], Card]] = {
    "linear": (linear.LinearRegression, Card("linear", "regression", True, "least squares with tests and intervals")),
    "ridge": (linear.Ridge, Card("ridge", "regression", True, "least squares with an L2 penalty")),
    "elastic_net": (linear.ElasticNet, Card("elastic_net", "regression", True, "least squares with L1 and L2 penalties")),
    "robust": (linear.RobustRegression, Card("robust", "regression", True, "least squares that gives outliers little weight")),
    "logistic": (linear.LogisticRegression, Card("logistic", "classification", True, "two classes with odds ratios")),
    "gaussian_nb": (bayes.GaussianNB, Card("gaussian_nb", "classification", True, "class means and variances")),
    "lda": (bayes.LDA, Card("lda", "classification", True, "linear discriminants")),
    "tree": (lambda **o: trees.DecisionTree("classification", **o), Card("tree", "classification", True, "one tree of classes")),
    "regression_tree": (lambda **o: trees.DecisionTree("regression", **o), Card("regression_tree", "regression", True, "one tree of numbers")),
}


def train(df: DataFrame, target: str, model: str, columns: Sequence[str] | None = None, **options):
    if model not in CATALOGUE:
        raise InvalidInput(f"no model {model}")
    columns = list(columns or Dataset.of(df, target).features)
    return CATALOGUE[model][0](**options).fit(df, columns, target)


def predict(df: DataFrame, model) -> DataFrame:
    return model.predict(df)


def evaluate(df: DataFrame, model, target: str, task: str) -> DataFrame:
    scored = model.predict(df)
    return metrics.regression_scores(scored, target, "prediction") if task == "regression" else metrics.classification_scores(scored, target, "prediction")


def compare(df: DataFrame, target: str, names: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None, folds: int = 5) -> list[dict]:
    """Cross-validated scores, the best first, with the interval and whether it beats the next."""
    columns = list(columns or Dataset.of(df, target).features)
    found = []
    for name in names:
        make, card = CATALOGUE[name]
        found.append((name, search.cross_val_score(make, df, columns, target, order, search.r2 if card.task == "regression" else search.accuracy, folds, card.task == "classification")))
    found.sort(key=lambda x: -x[1].mean)
    return [{"model": n, "mean": r.mean, "std": r.std, "interval": r.interval(), "clearly_better": i + 1 < len(found) and r.better_than(found[i + 1][1])} for i, (n, r) in enumerate(found)]


def diagnose(df: DataFrame, target: str, order: Sequence[str], columns: Sequence[str] | None = None) -> dict:
    """Residual checks of a least squares fit."""
    columns = list(columns or Dataset.of(df, target).features)
    model = linear.LinearRegression().fit(df, columns, target)
    return stats.diagnose_residuals(model.diagnose(df, target), "residual", order) | {"r2": model.r2, "f_p_value": model.f_p_value}


def recommend(df: DataFrame, target: str) -> list[tuple[str, float, str]]:
    data = Dataset.of(df, target)
    return search.recommend(search.meta_features(df, data.features, target), data.infer_task())


def automl(df: DataFrame, target: str, order: Sequence[str], trials: int = 10, seconds: float = 300.0) -> search.AutoML:
    data = Dataset.of(df, target)
    task = data.infer_task()
    portfolio = (
        {"ridge": (linear.Ridge, {"alpha": search.Param(1e-3, 1e3, log=True)}), "tree": (CATALOGUE["regression_tree"][0], {"max_depth": search.Param(2, 8, "int")})}
        if task == "regression"
        else {"gaussian_nb": (bayes.GaussianNB, {"var_smoothing": search.Param(1e-10, 1e-6, log=True)}), "tree": (CATALOGUE["tree"][0], {"max_depth": search.Param(2, 8, "int")})}
    )
    return search.AutoML(portfolio, task, trials, seconds).fit(df, list(data.features), target, order)


def export(model) -> str:
    """A linear model as a SQL expression of its columns."""
    if not isinstance(model, linear.LinearModel):
        raise InvalidInput("only linear models have an expression of this form")
    return " + ".join([repr(float(model.intercept)), *[f"{float(b)!r} * `{c}`" for c, b in zip(model.columns, model.coefficients)]])


def info(name: str) -> dict:
    return asdict(CATALOGUE[name][1])


def audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: kind, bounds, uniques, missing, and share of rows outside the outer fences."""
    kinds = infer_schema(df, columns)
    fences = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns]).first()
    outside = df.agg(*[F.avg(((F.col(c) < fences[c][0] - 3 * (fences[c][1] - fences[c][0])) | (F.col(c) > fences[c][1] + 3 * (fences[c][1] - fences[c][0]))).cast("double")).alias(c) for c in columns]).first()
    shares = df.sparkSession.createDataFrame([(c, outside[c]) for c in columns], "feature string, outlier_share double")
    return kinds.join(F.broadcast(shares), "feature")  # one row a column


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella")
    parser.add_argument("command", choices=["train", "predict", "evaluate", "compare", "diagnose", "recommend", "automl", "export", "info"])
    for name in ("data", "target", "model", "out"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--order", nargs="*", default=[])
    parser.add_argument("--task", default="regression")
    o = parser.parse_args(arguments)
    if o.command == "info":
        print(json.dumps(info(o.model)))
        return
    spark = SparkSession.builder.getOrCreate()
    df = files.read_file(spark, o.data) if o.data else None
    if o.command == "train":
        models.save_model(spark, train(df, o.target, o.model), o.out)
    elif o.command == "predict":
        predict(df, models.load_model(spark, o.model)).write.parquet(o.out)
    elif o.command == "evaluate":
        evaluate(df, models.load_model(spark, o.model), o.target, o.task).show(truncate=False)
    elif o.command == "compare":
        print(json.dumps(compare(df, o.target, o.model.split(","), o.order)))
    elif o.command == "diagnose":
        print(json.dumps(diagnose(df, o.target, o.order)))
    elif o.command == "recommend":
        print(json.dumps(recommend(df, o.target)))
    elif o.command == "automl":
        found = automl(df, o.target, o.order)
        print(json.dumps(found.leaderboard(), default=str))
    else:
        print(export(models.load_model(spark, o.model)))


if __name__ == "__main__":
    main()
