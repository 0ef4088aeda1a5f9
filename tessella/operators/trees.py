"""Trees, forests and boosting on binned columns.

Bins are exact (midpoints of distinct values) up to max_bins distinct values, quantiles
of the distinct values beyond. A level of a tree is one aggregate: sums by node, column
and bin, at most nodes * columns * bins rows for the driver, which picks the splits.
Predictions are expressions over the fitted nodes.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import clean, settled
from tessella.operators.linear import argmax, sigmoid


@dataclass
class BinMapper:
    """Cut points from the distinct values of each column; missing values have a bin of their own."""

    max_bins: int = 255
    columns: tuple[str, ...] = ()
    cuts: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> BinMapper:
        self.columns = tuple(columns)
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), clean(c).alias("v")) for c in columns])).alias("s")).select("s.*").filter("v IS NOT NULL").distinct()
        w = Window.partitionBy("feature")
        ranked = long.withColumn("i", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w)).withColumn("next", F.lead("v").over(w.orderBy("v")))
        every = F.col("n") <= self.max_bins
        step = F.floor((F.col("i") + 1) * self.max_bins / F.col("n")) > F.floor(F.col("i") * self.max_bins / F.col("n"))
        kept = ranked.filter(F.col("next").isNotNull() & (every | step)).select("feature", ((F.col("v") + F.col("next")) / 2).alias("cut"))
        found = kept.groupBy("feature").agg(F.sort_array(F.collect_list("cut")).alias("cuts")).collect()  # at most max_bins each
        self.cuts = {c: [] for c in columns} | {r["feature"]: list(r["cuts"]) for r in found}
        return self

    def expression(self, c: str) -> Column:
        """The number of cuts under x; -1 for missing."""
        x, cuts = clean(c), self.cuts[c]
        if not cuts:
            return F.when(x.isNull(), -1).otherwise(0)
        at = F.array(*[F.lit(float(v)) for v in cuts])
        return F.when(x.isNull(), -1).otherwise(F.aggregate(at, F.lit(0), lambda n, v: n + (v < x).cast("int")))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[self.expression(c).cast("int").alias(f"__b_{c}") for c in self.columns])


@dataclass
class Node:
    """A leaf's value (a number or class shares), or a split: x <= threshold goes left, missing by default_left."""

    value: object = None
    n: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    bin: int = 0
    default_left: bool = True
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.feature is None else self.left.leaves() + self.right.leaves()

    def depth(self) -> int:
        return 0 if self.feature is None else 1 + max(self.left.depth(), self.right.depth())

    def expression(self, value: Callable[[Node], Column], binned: bool = False) -> Column:
        if self.feature is None:
            return value(self)
        x = F.col(f"__b_{self.feature}") if binned else clean(self.feature)
        missing = x == -1 if binned else x.isNull()
        left = x <= (self.bin if binned else float(self.threshold))
        goes = F.when(missing, F.lit(self.default_left)).otherwise(left)
        return F.when(goes, self.left.expression(value, binned)).otherwise(self.right.expression(value, binned))


def impurity(stats: np.ndarray, criterion: str) -> np.ndarray:
    """Weighted impurity (times n) of rows of class counts, or of (n, sum, sum of squares)."""
    if criterion == "mse":
        n = np.maximum(stats[..., 0], 1e-300)
        return np.maximum(stats[..., 2] - stats[..., 1] ** 2 / n, 0)
    n = stats.sum(axis=-1)
    p = stats / np.maximum(n, 1e-300)[..., None]
    if criterion == "entropy":
        return n * -(p * np.log(np.maximum(p, 1e-300))).sum(axis=-1)
    return n * (1 - (p**2).sum(axis=-1))


@dataclass(frozen=True)
class Growth:
    """When a node may split and by what gain.

    ``criterion`` is gini, entropy or mse, or "newton" for (n, gradient, hessian) sums.
    """

    criterion: str = "gini"
    max_depth: int = 8
    min_split: float = 2
    min_leaf: float = 1
    min_gain: float = 0.0
    max_leaves: int | None = None
    max_features: int | None = None
    random_cuts: bool = False
    l1: float = 0.0
    l2: float = 0.0
    monotone: tuple[tuple[str, int], ...] = ()

    def score(self, s: np.ndarray) -> np.ndarray:
        """What a split should raise."""
        if self.criterion == "newton":
            g = np.sign(s[..., 1]) * np.maximum(np.abs(s[..., 1]) - self.l1, 0)
            return g**2 / (s[..., 2] + self.l2 + 1e-300)
        return -impurity(s, self.criterion)

    def size(self, s: np.ndarray) -> np.ndarray:
        return s[..., 0] if self.criterion in ("mse", "newton") else s.sum(axis=-1)

    def value(self, s: np.ndarray):
        if self.criterion == "newton":
            return float(-s[1] / (s[2] + self.l2 + 1e-300))
        if self.criterion == "mse":
            return float(s[1] / max(s[0], 1e-300))
        return (s / max(s.sum(), 1e-300)).tolist()


def grow(rows: DataFrame, bins: BinMapper, stats: Sequence[str], how: Growth, seed: int = 0) -> Node:
    """A tree from binned rows with the columns ``stats`` to add up, level by level."""
    rng = random.Random(seed)
    root = Node()
    total = np.array(rows.agg(*[F.sum(s) for s in stats]).first(), float)
    sums = {id(root): np.nan_to_num(total)}
    open_nodes, n_leaves = [root], 1
    signs = dict(how.monotone)
    for depth in range(how.max_depth + 1):
        for node in open_nodes:
            node.n, node.value = float(how.size(sums[id(node)])), how.value(sums[id(node)])
        open_nodes = [x for x in open_nodes if x.n >= how.min_split]
        if depth == how.max_depth or not open_nodes or (how.max_leaves and n_leaves >= how.max_leaves):
            break
        numbers = {id(x): i for i, x in enumerate(open_nodes)}
        at = root.expression(lambda x: F.lit(numbers.get(id(x), -1)), True)
        cells = F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(f"__b_{c}").alias("b")) for j, c in enumerate(bins.columns)])).alias("c")
        found = rows.select(at.alias("node"), *stats, cells).filter("node >= 0").groupBy("node", "c.f", "c.b").agg(*[F.sum(s).alias(s) for s in stats]).collect()
        tables: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for r in found:
            tables.setdefault((r["node"], r["f"]), {})[r["b"]] = np.array([r[s] for s in stats], float)
        wanted = []
        for i, node in enumerate(open_nodes):
            features = list(range(len(bins.columns)))
            if how.max_features and how.max_features < len(features):
                features = sorted(rng.sample(features, how.max_features))
            whole = sums[id(node)]
            base, best = float(how.score(whole)), None
            for j in features:
                table, cuts = tables.get((i, j), {}), bins.cuts[bins.columns[j]]
                if not cuts:
                    continue
                dense = np.zeros((len(cuts) + 1, len(stats)))
                for b, s in table.items():
                    if b >= 0:
                        dense[b] = s
                gap = table.get(-1)
                left = dense.cumsum(axis=0)[:-1]
                for side in (True, False) if gap is not None else (True,):
                    a = left + (gap if gap is not None and side else 0)
                    z = whole - a
                    gain = how.score(a) + how.score(z) - base
                    gain[(how.size(a) < how.min_leaf) | (how.size(z) < how.min_leaf)] = -np.inf
                    if bins.columns[j] in signs and how.criterion == "newton":
                        va, vz = -a[:, 1] / (a[:, 2] + how.l2 + 1e-300), -z[:, 1] / (z[:, 2] + how.l2 + 1e-300)
                        gain[(vz - va) * signs[bins.columns[j]] < 0] = -np.inf
                    valid = np.flatnonzero(gain > -np.inf)
                    if not len(valid):
                        continue
                    k = rng.choice(valid.tolist()) if how.random_cuts else int(gain.argmax())
                    if gain[k] > max(how.min_gain, 1e-12) and (best is None or gain[k] > best[0] + 1e-12):
                        best = float(gain[k]), j, k, side, a[k], z[k]
            if best:
                wanted.append((best, node))
        if how.max_leaves:
            wanted = sorted(wanted, key=lambda w: -w[0][0])[: how.max_leaves - n_leaves]
        open_nodes = []
        for (gain, j, k, side, a, z), node in wanted:
            c = bins.columns[j]
            node.feature, node.bin, node.threshold, node.default_left, node.gain = c, k, bins.cuts[c][k], side, gain
            node.left, node.right = Node(), Node()
            sums[id(node.left)], sums[id(node.right)] = a, z
            open_nodes += [node.left, node.right]
            n_leaves += 1
        if not open_nodes:
            break
    return root


def prune(node: Node, alpha: float) -> Node:
    """Cost-complexity pruning: a split goes if its gain for each leaf saved is at most alpha."""
    if node.feature is None:
        return node
    prune(node.left, alpha)
    prune(node.right, alpha)
    if node.left.feature is None and node.right.feature is None and node.gain <= alpha:
        node.feature = node.left = node.right = None
    return node


def importances(trees: Sequence[Node], columns: Sequence[str]) -> dict[str, float]:
    """Shares of the total gain."""
    found = dict.fromkeys(columns, 0.0)

    def walk(x):
        if x.feature is not None:
            found[x.feature] += x.gain
            walk(x.left)
            walk(x.right)

    for t in trees:
        walk(t)
    total = sum(found.values())
    return {c: v / total if total else 0.0 for c, v in found.items()}


def _poisson(row_id: str, *salt) -> Column:
    u = (F.pmod(F.xxhash64(row_id, *[F.lit(s) for s in salt]), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight = F.lit(6)
    for k in range(5, -1, -1):
        weight = F.when(u < sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), k).otherwise(weight)
    return weight.cast("double")


@dataclass
class Forest:
    """One tree, a bagged forest or extremely random trees; classes by mean shares, numbers by means.

    Bootstrap weights and out-of-bag rows come from hashes of ``row_id``.
    """

    task: str = "classification"
    n_trees: int = 1
    growth: Growth = Growth()
    bootstrap: bool = False
    max_bins: int = 255
    alpha: float = 0.0
    seed: int = 0
    weight: str | None = None

    def fit(self, df: DataFrame, columns: Sequence[str], target: str, row_id: str | None = None) -> Forest:
        self.columns = tuple(columns)
        bins = BinMapper(self.max_bins).fit(df, columns)
        how = self.growth
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        if self.task == "classification":
            self.classes = [r[0] for r in df.select(target).distinct().orderBy(target).collect()]
            made = [F.when(F.col(target) == F.lit(c), w).otherwise(0.0) for c in self.classes]
        else:
            how = Growth(**{**how.__dict__, "criterion": "mse"})
            made = [w, w * clean(target), w * clean(target) ** 2]
        stats = [f"__s{i}" for i in range(len(made))]
        keep = [F.col(row_id)] if row_id else []
        rows = bins.transform(df).select(*keep, *[f"__b_{c}" for c in columns], *[x.alias(s) for x, s in zip(made, stats)]).persist()
        try:
            self.trees = []
            for t in range(self.n_trees):
                own = rows
                if self.bootstrap:
                    own = rows.select(*[F.col(f"__b_{c}") for c in columns], *[(F.col(s) * _poisson(row_id, self.seed, t)).alias(s) for s in stats])
                tree = grow(own, bins, stats, how, self.seed * 1000 + t)
                self.trees.append(prune(tree, self.alpha) if self.alpha else tree)
        finally:
            rows.unpersist()
        self.importances = importances(self.trees, columns)
        return self

    def _shares(self, weights: Sequence[Column] | None = None) -> list[Column]:
        n = len(self.classes)
        each = [[t.expression(lambda x, k=k: F.lit(float(x.value[k]))) for t in self.trees] for k in range(n)]
        return [sum(e[1:], e[0]) / len(e) for e in each] if weights is None else [sum((x * w for x, w in zip(e, weights)), F.lit(0.0)) for e in each]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.task == "classification":
            return df.withColumn(name, argmax(self._shares(), self.classes))
        each = [t.expression(lambda x: F.lit(float(x.value))) for t in self.trees]
        return df.withColumn(name, sum(each[1:], each[0]) / len(each))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[s.alias(f"probability_{c}") for s, c in zip(self._shares(), self.classes)])

    def out_of_bag(self, df: DataFrame, target: str, row_id: str) -> float:
        """Accuracy or R2 over rows by the trees that haven't drawn them."""
        absent = [F.when(_poisson(row_id, self.seed, t) == 0, 1.0).otherwise(0.0) for t in range(self.n_trees)]
        n = sum(absent[1:], absent[0])
        if self.task == "classification":
            guess = argmax(self._shares(absent), self.classes)
            return df.filter(n > 0).agg(F.avg((guess == F.col(target)).cast("double"))).first()[0]
        each = [t.expression(lambda x: F.lit(float(x.value))) for t in self.trees]
        guess = sum((x * w for x, w in zip(each, absent)), F.lit(0.0)) / n
        y = clean(target)
        return df.filter(n > 0).agg(1 - F.sum((y - guess) ** 2) / (F.var_pop(y) * F.count(y))).first()[0]


def DecisionTree(task: str = "classification", alpha: float = 0.0, max_bins: int = 255, **growth) -> Forest:
    return Forest(task, 1, Growth(**growth), False, max_bins, alpha)


def RandomForest(task: str, n_columns: int, n_trees: int = 100, seed: int = 0, **growth) -> Forest:
    """Square root of the columns a node for classes, a third for numbers."""
    k = max(1, int(math.sqrt(n_columns)) if task == "classification" else n_columns // 3)
    return Forest(task, n_trees, Growth(**({"max_features": k} | growth)), True, seed=seed)


def ExtraTrees(task: str, n_columns: int, n_trees: int = 100, seed: int = 0, **growth) -> Forest:
    k = max(1, int(math.sqrt(n_columns)) if task == "classification" else n_columns // 3)
    return Forest(task, n_trees, Growth(**({"max_features": k, "random_cuts": True} | growth)), False, seed=seed)


@dataclass
class GradientBoosting:
    """Newton boosting of histogram trees: squared, absolute, huber, log (binary) or multiclass loss.

    Raw scores are a column; every ``settle`` rounds it is checkpointed, so plans stay short.
    """

    loss: str = "squared"
    n_rounds: int = 100
    rate: float = 0.1
    growth: Growth = Growth(criterion="newton", max_depth=6, min_leaf=20, max_leaves=31)
    max_bins: int = 255
    subsample: float = 1.0
    delta: float = 1.0
    tolerance: float | None = None
    settle: int = 10
    seed: int = 0

    def fit(self, df: DataFrame, columns: Sequence[str], target: str, row_id: str) -> GradientBoosting:
        self.columns = tuple(columns)
        bins = BinMapper(self.max_bins).fit(df, columns)
        y = F.col("__y")
        if self.loss in ("log", "multiclass"):
            self.classes = [r[0] for r in df.select(target).distinct().orderBy(target).collect()]
            if self.loss == "log" and len(self.classes) != 2:
                raise InvalidInput("the log loss wants two classes")
            code = argmax([F.when(F.col(target) == F.lit(c), 1.0).otherwise(0.0) for c in self.classes], list(range(len(self.classes)))).cast("double")
        else:
            self.classes, code = None, clean(target)
        k = len(self.classes) if self.loss == "multiclass" else 1
        rows = bins.transform(df).select(row_id, code.alias("__y"), *[f"__b_{c}" for c in columns])
        if self.loss == "multiclass":
            share = {r[0]: r[1] for r in rows.groupBy("__y").agg(F.count("*")).collect()}
            total = sum(share.values())
            self.start = [math.log(share[float(i)] / total) for i in range(k)]
        elif self.loss == "log":
            p = rows.agg(F.avg(y)).first()[0]
            self.start = [math.log(p / (1 - p))]
        else:
            self.start = [rows.agg(F.avg(y) if self.loss == "squared" else F.percentile(y, F.lit(0.5))).first()[0]]
        rows = settled(rows.select("*", *[F.lit(float(s)).alias(f"__f{i}") for i, s in enumerate(self.start)]))
        self.trees, self.losses = [], []
        for r in range(self.n_rounds):
            f = [F.col(f"__f{i}") for i in range(k)]
            top = F.greatest(*f) if k > 1 else f[0]
            mass = sum((F.exp(x - top) for x in f), F.lit(0.0))
            stage = []
            for i in range(k):
                if self.loss == "multiclass":
                    p = F.exp(f[i] - top) / mass
                    g, h = p - F.when(y == i, 1.0).otherwise(0.0), F.greatest(p * (1 - p), F.lit(1e-6))
                elif self.loss == "log":
                    p = sigmoid(f[0])
                    g, h = p - y, F.greatest(p * (1 - p), F.lit(1e-6))
                elif self.loss == "absolute":
                    g, h = F.signum(f[0] - y), F.lit(1.0)
                elif self.loss == "huber":
                    g, h = F.least(F.greatest(f[0] - y, F.lit(-self.delta)), F.lit(self.delta)), F.lit(1.0)
                else:
                    g, h = f[0] - y, F.lit(1.0)
                own = rows.select(*[f"__b_{c}" for c in columns], F.lit(1.0).alias("__n"), g.alias("__g"), h.alias("__h"), row_id)
                if self.subsample < 1:
                    own = own.filter(F.pmod(F.xxhash64(row_id, F.lit(self.seed), F.lit(r)), F.lit(1 << 30)) < int(self.subsample * (1 << 30)))
                stage.append(grow(own, bins, ["__n", "__g", "__h"], self.growth, self.seed + r * k + i))
            self.trees.append(stage)
            changed = {f"__f{i}": F.col(f"__f{i}") + self.rate * t.expression(lambda x: F.lit(float(x.value)), True) for i, t in enumerate(stage)}
            rows = rows.withColumns(changed)
            if (r + 1) % self.settle == 0:
                rows = settled(rows)
                if self.tolerance is not None:
                    self.losses.append(self._loss(rows, k))
                    if len(self.losses) > 1 and self.losses[-2] - self.losses[-1] < self.tolerance:
                        break
        self.importances = importances([t for s in self.trees for t in s], columns)
        return self

    def _loss(self, rows, k):
        y, f = F.col("__y"), [F.col(f"__f{i}") for i in range(k)]
        if self.loss == "log":
            each = F.ln(1 + F.exp(-F.abs(f[0]))) + F.greatest(f[0], F.lit(0.0)) - y * f[0]
        elif self.loss == "multiclass":
            top = F.greatest(*f)
            each = top + F.ln(sum((F.exp(x - top) for x in f), F.lit(0.0))) - sum((F.when(y == i, x).otherwise(0.0) for i, x in enumerate(f)), F.lit(0.0))
        else:
            each = (y - f[0]) ** 2 if self.loss == "squared" else F.abs(y - f[0])
        return rows.agg(F.avg(each)).first()[0]

    def raw(self) -> list[Column]:
        return [F.lit(float(s)) + self.rate * sum((stage[i].expression(lambda x: F.lit(float(x.value))) for stage in self.trees), F.lit(0.0)) for i, s in enumerate(self.start)]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        f = self.raw()
        if self.loss == "multiclass":
            return df.withColumn(name, argmax(f, self.classes))
        return df.withColumn(name, F.when(f[0] > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])) if self.loss == "log" else f[0])

    def predict_proba(self, df: DataFrame) -> DataFrame:
        f = self.raw()
        if self.loss == "log":
            return df.withColumn("probability", sigmoid(f[0]))
        top = F.greatest(*f)
        mass = sum((F.exp(x - top) for x in f), F.lit(0.0))
        return df.select("*", *[(F.exp(x - top) / mass).alias(f"probability_{c}") for x, c in zip(f, self.classes)])


@dataclass
class AdaBoostClassifier:
    """SAMME: shallow trees on reweighted rows, votes by their log odds."""

    n_rounds: int = 50
    rate: float = 1.0
    max_depth: int = 1

    def fit(self, df: DataFrame, columns: Sequence[str], target: str) -> AdaBoostClassifier:
        self.classes = [r[0] for r in df.select(target).distinct().orderBy(target).collect()]
        k = len(self.classes)
        rows = df.select(F.col(target), *columns, F.lit(1.0 / df.count()).alias("__w"))
        self.stages = []
        for r in range(self.n_rounds):
            tree = Forest("classification", 1, Growth(max_depth=self.max_depth, min_split=0, min_leaf=0), weight="__w").fit(rows, columns, target)
            guess = argmax(tree._shares(), tree.classes)
            err = rows.agg(F.sum(F.when(guess != F.col(target), F.col("__w")).otherwise(0.0)) / F.sum("__w")).first()[0]
            if err >= 1 - 1 / k:
                break
            err = min(max(err, 1e-10), 1 - 1e-10)
            alpha = self.rate * (math.log((1 - err) / err) + math.log(k - 1))
            self.stages.append((alpha, tree))
            w = F.col("__w") * F.when(guess != F.col(target), math.exp(alpha)).otherwise(1.0)
            total = 1 + err * (math.exp(alpha) - 1)
            rows = rows.withColumn("__w", w / total)
            if r % 5 == 4:
                rows = settled(rows)
            if err <= 1e-9:
                break
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        guesses = [(a, argmax(t._shares(), t.classes)) for a, t in self.stages]
        votes = [sum((F.when(g == F.lit(c), a).otherwise(0.0) for a, g in guesses), F.lit(0.0)) for c in self.classes]
        return df.withColumn(name, argmax(votes, self.classes))


@dataclass
class AdaBoostRegressor:
    """R2: trees on reweighted rows, the weighted median of their predictions."""

    n_rounds: int = 20
    rate: float = 1.0
    loss: str = "linear"
    max_depth: int = 3

    def fit(self, df: DataFrame, columns: Sequence[str], target: str) -> AdaBoostRegressor:
        rows = df.select(F.col(target), *columns, F.lit(1.0 / df.count()).alias("__w"))
        self.stages = []
        for r in range(self.n_rounds):
            tree = Forest("regression", 1, Growth("mse", self.max_depth, 0, 0), weight="__w").fit(rows, columns, target)
            e = F.abs(clean(target) - tree.trees[0].expression(lambda x: F.lit(float(x.value))))
            top = rows.agg(F.max(e)).first()[0]
            if not top:
                self.stages.append((1.0, tree))
                break
            l = {"linear": e / top, "square": (e / top) ** 2, "exponential": 1 - F.exp(-e / top)}[self.loss]
            mean = rows.agg(F.sum(F.col("__w") * l) / F.sum("__w")).first()[0]
            if mean >= 0.5:
                break
            beta = max(mean, 1e-10) / (1 - mean)
            self.stages.append((self.rate * math.log(1 / beta), tree))
            rows = rows.withColumn("__w", F.col("__w") * F.pow(F.lit(beta), self.rate * (1 - l)))
            if r % 5 == 4:
                rows = settled(rows)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        each = F.array_sort(F.array(*[F.struct(t.trees[0].expression(lambda x: F.lit(float(x.value))).alias("v"), F.lit(float(a)).alias("a")) for a, t in self.stages]))
        half = sum(a for a, _ in self.stages) / 2
        upto = F.aggregate(each, F.struct(F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("v")), lambda s, x: F.struct((s["t"] + x["a"]).alias("t"), F.coalesce(s["v"], F.when(s["t"] + x["a"] >= half, x["v"])).alias("v")))
        return df.withColumn(name, upto["v"])


def ordered_target_encoding(df: DataFrame, column: str, target: str, order: Sequence[str], smoothing: float = 1.0) -> DataFrame:
    """A category's smoothed target mean over the rows before, in the given order."""
    overall = df.agg(F.avg(clean(target))).first()[0]
    before = Window.partitionBy(column).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total, n = F.coalesce(F.sum(clean(target)).over(before), F.lit(0.0)), F.count(target).over(before)
    return df.withColumn(f"{column}_encoded", (total + smoothing * overall) / (n + smoothing))
