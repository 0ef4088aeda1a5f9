"""Nearest neighbours, and the resamplers, outlier scores and classifiers built on them.

Exact neighbours compare every query with every row, in blocks (see pairs); the blocks'
best are merged by a grouped top-k. Ids are integers, vectors arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidInput
from tessella.frame import in_order
from tessella.operators.pairs import nearest, reduce_pairs
from tessella.operators.splits import within_class


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if metric == "euclidean":
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    if metric == "manhattan":
        return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)
    if metric == "minkowski":
        return F.pow(F.aggregate(gap, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(p))), F.lit(1 / p))
    raise InvalidInput(f"no metric {metric}")


def vector(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def neighbors(queries: DataFrame, rows: DataFrame, k: int, row_id: str = "id", vec: str = "vector", metric: str = "euclidean", exclude_self: bool = False, p: float = 2.0) -> DataFrame:
    """(query, neighbor, distance, rank): each query's k nearest rows, ties to the smaller id."""
    if metric not in ("euclidean", "manhattan", "minkowski"):
        raise InvalidInput(f"no metric {metric}")
    if not isinstance(queries.schema[row_id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise InvalidInput("neighbours need integer ids")
    found = reduce_pairs(queries, rows, nearest(k, metric, exclude_self, p), "query long, neighbor long, distance double", row_id, vec)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _weight(weights: str) -> Column:
    return F.lit(1.0) if weights == "uniform" else 1 / (F.col("distance") + 1e-10)


@dataclass
class KNeighborsClassifier:
    """The class of greatest (weighted) vote, ties to the smallest."""

    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    row_id: str = "id"
    vector: str = "vector"

    def fit(self, df: DataFrame, target: str) -> KNeighborsClassifier:
        self.rows, self.target = df, target
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        found = neighbors(df, self.rows, self.k, self.row_id, self.vector, self.metric)
        labels = self.rows.select(F.col(self.row_id).alias("neighbor"), F.col(self.target).alias("class"))
        votes = found.join(labels, "neighbor").groupBy("query", "class").agg(F.sum(_weight(self.weights)).alias("v"))
        return votes.select("query", "class", (F.col("v") / F.sum("v").over(Window.partitionBy("query"))).alias("probability"))

    def predict(self, df: DataFrame) -> DataFrame:
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("probability", 12)), "class"))
        return self.predict_proba(df).withColumn("__r", best).filter("__r = 1").select("query", F.col("class").alias("prediction"))


@dataclass
class KNeighborsRegressor:
    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    row_id: str = "id"
    vector: str = "vector"

    def fit(self, df: DataFrame, target: str) -> KNeighborsRegressor:
        self.rows, self.target = df, target
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        found = neighbors(df, self.rows, self.k, self.row_id, self.vector, self.metric)
        values = self.rows.select(F.col(self.row_id).alias("neighbor"), F.col(self.target).cast("double").alias("__y"))
        w = _weight(self.weights)
        return found.join(values, "neighbor").groupBy("query").agg((F.sum(w * F.col("__y")) / F.sum(w)).alias("prediction"))


@dataclass
class NearestCentroid:
    """The class of the nearest mean; optionally shrunken towards the overall mean."""

    shrink_threshold: float | None = None
    row_id: str = "id"
    vector: str = "vector"

    def fit(self, df: DataFrame, target: str) -> NearestCentroid:
        flat = df.select(F.col(target).alias("class"), F.posexplode(self.vector).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
        means = flat.groupBy("class", "d").agg(F.avg("x").alias("m"), F.count("x").alias("n"), F.var_pop("x").alias("v"))
        if self.shrink_threshold is not None:
            w = Window.partitionBy("d")
            total, k = F.sum("n").over(w), F.count("*").over(w)
            overall = F.sum(F.col("n") * F.col("m")).over(w) / total
            s = F.sqrt(F.sum(F.col("n") * F.col("v")).over(w) / (total - k))
            means = means.withColumn("o", overall).withColumn("s", s).withColumn("t", total)
            means = means.withColumn("s", F.col("s") + F.percentile("s", F.lit(0.5)).over(Window.partitionBy()))
            scale = F.sqrt(1 / F.col("n") - 1 / F.col("t")) * F.col("s")
            z = (F.col("m") - F.col("o")) / scale
            means = means.withColumn("m", F.col("o") + scale * F.signum(z) * F.greatest(F.abs(z) - self.shrink_threshold, F.lit(0.0)))
        self.centroids = means.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c")).select("class", F.col("c.m").alias("centroid"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        q = df.select(F.col(self.row_id).alias("query"), F.col(self.vector).alias("__u"))
        d = distance(F.col("__u"), F.col("centroid"))
        pairs = q.join(self.centroids, F.lit(True)).select("query", "class", d.alias("d"))
        return pairs.groupBy("query").agg(F.min_by("class", F.struct("d", "class")).alias("prediction"))


def local_outlier_factor(df: DataFrame, k: int = 20, row_id: str = "id", vec: str = "vector", metric: str = "euclidean") -> DataFrame:
    """(query, lrd, score): the negative local outlier factor; under -1.5 is an outlier by default."""
    near = neighbors(df, df, k, row_id, vec, metric, exclude_self=True)
    reach_of = near.groupBy("query").agg(F.max("distance").alias("kd"))
    reach = near.join(reach_of.select(F.col("query").alias("neighbor"), "kd"), "neighbor").withColumn("reach", F.greatest("kd", "distance"))
    lrd = reach.groupBy("query").agg(F.avg("reach").alias("m")).select("query", F.when(F.col("m") > 0, 1 / F.col("m")).otherwise(float("inf")).alias("lrd"))
    joined = near.join(lrd, "query").join(lrd.select(F.col("query").alias("neighbor"), F.col("lrd").alias("nl")), "neighbor")
    inf = float("inf")
    ratio = F.when(F.col("nl") == inf, 1.0).otherwise(F.col("nl") / F.col("lrd"))
    return joined.groupBy("query", "lrd").agg(F.avg(ratio).alias("r")).select("query", "lrd", F.when(F.col("lrd") == inf, -1.0).otherwise(-F.col("r")).alias("score"))


def tomek_links(df: DataFrame, label: str, row_id: str = "id", vec: str = "vector") -> DataFrame:
    """(a, b): mutual nearest neighbours of different classes, a < b."""
    near = neighbors(df, df, 1, row_id, vec, exclude_self=True).select(F.col("query").alias("a"), F.col("neighbor").alias("b"))
    back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
    y = df.select(F.col(row_id).alias("__i"), F.col(label).alias("__y"))
    links = near.join(back, ["a", "b"]).filter("a < b")
    links = links.join(y.select(F.col("__i").alias("a"), F.col("__y").alias("ya")), "a").join(y.select(F.col("__i").alias("b"), F.col("__y").alias("yb")), "b")
    return links.filter("ya <> yb").select("a", "b")


def edited_nearest(df: DataFrame, label: str, k: int = 3, kind: str = "all", row_id: str = "id", vec: str = "vector") -> DataFrame:
    """Ids of rows to remove: all (all) or most (mode) of their k neighbours differ in class."""
    y = df.select(F.col(row_id).alias("__i"), F.col(label).alias("__y"))
    near = neighbors(df, df, k, row_id, vec, exclude_self=True)
    votes = near.join(y.select(F.col("__i").alias("query"), F.col("__y").alias("own")), "query").join(y.select(F.col("__i").alias("neighbor"), F.col("__y").alias("other")), "neighbor")
    per = votes.groupBy("query").agg(F.count_if(F.col("own") != F.col("other")).alias("differ"), F.count("*").alias("n"))
    rule = F.col("differ") == F.col("n") if kind == "all" else F.col("differ") * 2 > F.col("n")
    return per.filter(rule).select(F.col("query").alias(row_id))


def target_counts(df: DataFrame, label: str, strategy: str | float | dict = "auto", under: bool = False) -> dict:
    """How many rows each class should have: auto, a ratio to the majority (or minority), or counts."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if isinstance(strategy, dict):
        return n | strategy
    edge = min(n.values()) if under else max(n.values())
    if isinstance(strategy, float):
        return {c: min(v, int(edge / strategy)) if under else max(v, int(edge * strategy)) if v < edge else v for c, v in n.items()}
    return dict.fromkeys(n, edge)


def random_under_sample(df: DataFrame, label: str, row_id: str = "id", strategy="auto", seed: int = 0) -> DataFrame:
    """The first rows of each class in hashed order, up to its target."""
    goal = target_counts(df, label, strategy, under=True)
    placed = within_class(df, label, [F.xxhash64(row_id, F.lit(seed)), row_id], "__r")
    keep = F.lit(False)
    for c, k in goal.items():
        keep = keep | ((F.col(label) == F.lit(c)) & (F.col("__r") < k))
    return placed.filter(keep).select(*df.columns)


def random_over_sample(df: DataFrame, label: str, row_id: str = "id", strategy="auto", seed: int = 0) -> DataFrame:
    """Copies of rows in hashed order until each class has its target; column ``copy`` is 0 for originals."""
    goal = target_counts(df, label, strategy)
    placed = within_class(df, label, [F.xxhash64(row_id, F.lit(seed)), row_id], "__r")
    want = F.lit(0)
    for c, k in goal.items():
        want = F.when(F.col(label) == F.lit(c), k).otherwise(want)
    times = F.floor(want / F.col("__n")) + F.when(F.col("__r") < want % F.col("__n"), 1).otherwise(0)
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(1)).cast("int") - 1))).select(*df.columns, "copy")


def smote(df: DataFrame, label: str, row_id: str = "id", vec: str = "vector", k: int = 5, strategy="auto", seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """Original rows and synthetic ones between a row and one of its k neighbours in its class.

    Synthetic rows have a null id. Row, neighbour and place come from hashes, so a seed
    fixes the result. ``weights`` (row_id, weight) limits and weighs the rows that are used.
    """
    goal = target_counts(df, label, strategy)
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    parts = [df.select(F.col(row_id).alias(row_id), F.col(vec).cast("array<double>").alias(vec), F.col(label).alias(label))]
    for c in sorted(goal, key=str):
        extra = goal[c] - n.get(c, 0)
        if extra <= 0 or n.get(c, 0) < 2:
            continue
        own = df.filter(F.col(label) == F.lit(c))
        base = own if weights is None else own.join(weights, row_id)
        near = neighbors(base, own, min(k, n[c] - 1), row_id, vec, exclude_self=True)
        order = [F.xxhash64(row_id, F.lit(seed))] if weights is None else [F.desc(F.col("weight") / (F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 20)) + 1))]
        numbered = in_order(base, [*order, row_id]).select(F.col(row_id).alias("query"), F.col(vec).alias("__u"), "__i", F.lit(base.count()).alias("__n"))
        chosen = numbered.filter(F.col("__i") < extra).withColumn("__s", F.explode(F.sequence(F.lit(0), F.floor((F.lit(extra - 1) - F.col("__i")) / F.col("__n")).cast("int"))))
        chosen = chosen.withColumn("rank", (F.pmod(F.xxhash64("query", "__s", F.lit(seed)), F.lit(min(k, n[c] - 1))) + 1).cast("int"))
        u = F.pmod(F.xxhash64("query", "__s", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40)
        made = chosen.join(near, ["query", "rank"]).join(own.select(F.col(row_id).alias("neighbor"), F.col(vec).alias("__v")), "neighbor").withColumn("__t", u)
        point = F.zip_with("__u", "__v", lambda x, y: x.cast("double") + F.col("__t") * (y.cast("double") - x.cast("double")))
        parts.append(made.select(F.lit(None).cast(df.schema[row_id].dataType).alias(row_id), point.alias(vec), F.lit(c).cast(df.schema[label].dataType).alias(label)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _other_share(df: DataFrame, label: str, m: int, row_id: str, vec: str) -> DataFrame:
    y = df.select(F.col(row_id).alias("__i"), F.col(label).alias("__y"))
    near = neighbors(df, df, m, row_id, vec, exclude_self=True)
    v = near.join(y.select(F.col("__i").alias("query"), F.col("__y").alias("own")), "query").join(y.select(F.col("__i").alias("neighbor"), F.col("__y").alias("other")), "neighbor")
    return v.groupBy(F.col("query").alias(row_id)).agg(F.avg((F.col("own") != F.col("other")).cast("double")).alias("share"))


def borderline_smote(df: DataFrame, label: str, row_id: str = "id", vec: str = "vector", k: int = 5, m: int = 10, strategy="auto", seed: int = 0) -> DataFrame:
    """SMOTE from rows in danger: half or more, but not all, of their m neighbours are of other classes."""
    danger = _other_share(df, label, m, row_id, vec).filter("share >= 0.5 AND share < 1").select(row_id, F.lit(1.0).alias("weight"))
    return smote(df, label, row_id, vec, k, strategy, seed, danger)


def adasyn(df: DataFrame, label: str, row_id: str = "id", vec: str = "vector", k: int = 5, n: int = 5, strategy="auto", seed: int = 0) -> DataFrame:
    """SMOTE that favours rows with many neighbours of other classes."""
    return smote(df, label, row_id, vec, k, strategy, seed, _other_share(df, label, n, row_id, vec).filter("share > 0").withColumnRenamed("share", "weight"))


def _numbered(df: DataFrame, row_id: str) -> DataFrame:
    top = F.coalesce(F.max(row_id).over(Window.partitionBy()), F.lit(0))
    return df.withColumn(row_id, F.coalesce(row_id, top + F.row_number().over(Window.partitionBy(F.col(row_id).isNull()).orderBy(F.xxhash64("*")))))


def smote_tomek(df: DataFrame, label: str, row_id: str = "id", vec: str = "vector", k: int = 5, seed: int = 0) -> DataFrame:
    """SMOTE, then the majority ends of Tomek links go."""
    counts = df.groupBy(label).count().orderBy(F.desc("count"), label).first()
    both = _numbered(smote(df, label, row_id, vec, k, seed=seed), row_id)
    ends = tomek_links(both, label, row_id, vec).select(F.explode(F.array("a", "b")).alias(row_id))
    drop = both.filter(F.col(label) == F.lit(counts[0])).join(ends, row_id).select(row_id)
    return both.join(drop, row_id, "left_anti")


def smote_enn(df: DataFrame, label: str, row_id: str = "id", vec: str = "vector", k: int = 5, enn_k: int = 3, kind: str = "all", seed: int = 0) -> DataFrame:
    both = _numbered(smote(df, label, row_id, vec, k, seed=seed), row_id)
    return both.join(edited_nearest(both, label, enn_k, kind, row_id, vec), row_id, "left_anti")


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Random trees on hashed samples of at most ``max_samples`` rows; the score is -2^(-depth / c).

    The samples have a fixed size, so they are what goes to the driver; scoring is by batches.
    """

    n_trees: int = 100
    max_samples: int = 256
    contamination: float | None = None
    seed: int = 0

    def fit(self, df: DataFrame, columns: Sequence[str], row_id: str) -> IsolationForest:
        self.columns = tuple(columns)
        per = Window.partitionBy("__t").orderBy(F.xxhash64(row_id, "__t", F.lit(self.seed)))
        n = df.count()
        share = min(1.0, 4 * self.max_samples / max(n, 1))
        u = F.pmod(F.xxhash64(row_id, "__t", F.lit(self.seed)), F.lit(1 << 30)) / float(1 << 30)
        drawn = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in columns], F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1))).alias("__t")).filter(u < share)
        rows = drawn.withColumn("__r", F.row_number().over(per)).filter(F.col("__r") <= self.max_samples).select("__t", *columns).toPandas()
        rng = np.random.default_rng(self.seed)
        self.psi = min(self.max_samples, n)
        depth = math.ceil(math.log2(max(self.psi, 2)))
        self.trees = [self._grow(g[list(columns)].to_numpy(), 0, depth, rng) for _, g in rows.groupby("__t")]
        self.offset = -0.5
        if self.contamination:
            self.offset = self.score(df, row_id).agg(F.percentile("score", F.lit(self.contamination))).first()[0]
        return self

    def _grow(self, x, depth, limit, rng):
        if depth >= limit or len(x) <= 1 or (x.max(axis=0) == x.min(axis=0)).all():
            return depth + average_path(len(x))
        j = int(rng.choice(np.flatnonzero(x.max(axis=0) > x.min(axis=0))))
        cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
        left = x[:, j] < cut
        return j, cut, self._grow(x[left], depth + 1, limit, rng), self._grow(x[~left], depth + 1, limit, rng)

    def score(self, df: DataFrame, row_id: str) -> DataFrame:
        trees, columns, c = self.trees, list(self.columns), average_path(self.psi)

        def walk(tree, x, at, out):
            if not isinstance(tree, tuple):
                out[at] += tree
                return
            j, cut, a, b = tree
            left = x[at, j] < cut
            walk(a, x, at[left], out)
            walk(b, x, at[~left], out)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x, total = pdf[columns].to_numpy(float), np.zeros(len(pdf))
                for tree in trees:
                    walk(tree, x, np.arange(len(x)), total)
                yield pd.DataFrame({row_id: pdf[row_id], "score": -(2.0 ** (-total / len(trees) / c))})

        return df.select(row_id, *columns).mapInPandas(each, f"{row_id} {df.schema[row_id].dataType.simpleString()}, score double")

    def predict(self, df: DataFrame, row_id: str) -> DataFrame:
        return self.score(df, row_id).withColumn("prediction", F.when(F.col("score") < self.offset, -1).otherwise(1))
