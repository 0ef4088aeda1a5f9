"""Feature selection: one aggregate gives all scores, the best k are kept."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import clean


def _long(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    return df.select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), clean(c).alias("x")) for c in columns])).alias("s")).select("y", "s.*")


def f_classif(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, score, df_between, df_within): the ANOVA F of each column over the classes."""
    per = _long(df, columns, target).groupBy("feature", "y").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    s = per.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"))
    between = F.col("q") - F.col("t") ** 2 / F.col("n")
    score = F.when(F.col("w") >= 1e-15, (between / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))))
    return s.select("feature", score.alias("score"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def f_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, score, n): r^2 (n - 2) / (1 - r^2)."""
    s = _long(df, columns, target).groupBy("feature").agg(F.corr("x", F.col("y").cast("double")).alias("r"), F.count("x").alias("n"))
    r2 = F.coalesce(F.col("r") ** 2, F.lit(0.0))
    return s.select("feature", F.when(1 - r2 < 1e-15, float("inf")).otherwise(r2 * (F.col("n") - 2) / (1 - r2)).alias("score"), "n")


def chi2(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, score, df): sums by class against those that the class sizes would give."""
    per = _long(df, columns, target).groupBy("feature", "y").agg(F.sum("x").alias("o"), F.count("x").alias("n"), F.min("x").alias("low"))
    totals = per.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("n").alias("rows"), F.min("low").alias("low"))
    e = F.col("t") * F.col("n") / F.col("rows")
    term = F.when(e > 0, (F.col("o") - e) ** 2 / e).otherwise(0.0)
    found = per.drop("low").join(totals, "feature").groupBy("feature").agg(F.sum(term).alias("score"), (F.count("*") - 1).alias("df"), F.min("low").alias("low"))
    return found.withColumn("score", F.when(F.col("low") >= 0, F.col("score")).otherwise(F.raise_error(F.lit("chi2 needs non-negative values")).cast("double"))).drop("low")


@dataclass
class SelectKBest:
    """The k best columns in their original order; missing scores rank last, ties by column order."""

    k: int = 10
    score: Callable = f_classif
    scores: dict = field(default_factory=dict)
    columns: tuple[str, ...] = ()

    def fit(self, df: DataFrame, columns: Sequence[str], target: str) -> SelectKBest:
        self.scores = {r["feature"]: r["score"] for r in self.score(df, columns, target).collect()}
        rank = sorted(columns, key=lambda c: -(self.scores[c] if self.scores[c] is not None else -math.inf))
        chosen = set(rank[: self.k])
        self.columns, self.all = tuple(c for c in columns if c in chosen), tuple(columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.all if c not in self.columns])


def select_from_importances(importances: dict[str, float], threshold: float | str = "mean", max_features: int | None = None) -> list[str]:
    """Columns of an importance at or above a value, "mean", "median" or "mean+<k>*std"."""
    values = sorted(importances.values())
    mean = sum(values) / len(values)
    if threshold == "mean":
        bar = mean
    elif threshold == "median":
        h = len(values) // 2
        bar = values[h] if len(values) % 2 else (values[h - 1] + values[h]) / 2
    elif isinstance(threshold, str):
        k = float(threshold.removeprefix("mean+").removesuffix("*std"))
        bar = mean + k * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    else:
        bar = threshold
    kept = [c for c, v in importances.items() if v >= bar]
    if max_features is not None:
        best = set(sorted(kept, key=lambda c: -importances[c])[:max_features])
        kept = [c for c in kept if c in best]
    if not kept:
        raise InvalidInput("no column is important enough")
    return kept


def recursive_elimination(importance: Callable[[list[str]], dict[str, float]], columns: Sequence[str], n: int, step: int = 1) -> tuple[list[str], dict[str, int]]:
    """Refit and drop the weakest until n are left: those, and every column's rank (1 is kept)."""
    left, rank, rounds = list(columns), {}, []
    while len(left) > n:
        found = importance(left)
        drop = sorted(left, key=lambda c: found[c])[: min(step, len(left) - n)]
        rounds.append(drop)
        left = [c for c in left if c not in drop]
    for i, drop in enumerate(reversed(rounds)):
        rank |= dict.fromkeys(drop, i + 2)
    return left, rank | dict.fromkeys(left, 1)
