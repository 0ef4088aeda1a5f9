"""Scalers, encoders, imputers, discretisers and expansions.

Each fit is one aggregate (grouped where categories are counted); each transform is a
select of expressions over the fitted literals, or a join with a category table where
the categories' number has no bound.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import InvalidInput, NotFitted, ShapeMismatch
from tessella.frame import clean
from tessella.functions.specfun import normal_quantile

TINY = 1e-10


class Transformer:
    """Fit on columns of a table, then change them; other columns stay."""

    columns: tuple[str, ...] = ()

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Transformer:
        raise NotImplementedError

    def expressions(self) -> dict[str, Column]:
        raise NotImplementedError

    def inverse_expressions(self) -> dict[str, Column]:
        raise NotImplementedError(f"{type(self).__name__} can't be inverted")

    def _apply(self, df: DataFrame, made: dict[str, Column]) -> DataFrame:
        if not self.columns:
            raise NotFitted(type(self).__name__)
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ShapeMismatch(f"columns are missing: {missing}")
        return df.select([made.pop(c).alias(c) if c in made else F.col(c) for c in df.columns] + [x.alias(c) for c, x in made.items()])

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, dict(self.expressions()))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, dict(self.inverse_expressions()))

    def fit_transform(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)


def aggregate(df: DataFrame, columns: Sequence[str], **functions) -> dict[str, dict[str, float]]:
    """{column: {name: value}} of several aggregates in one job."""
    row = df.agg(*[f(clean(c)).alias(f"{name}:{c}") for c in columns for name, f in functions.items()]).first()
    return {c: {name: row[f"{name}:{c}"] for name in functions} for c in columns}


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> dict[str, list[float]]:
    """Exact, linearly interpolated quantiles of each column in one job."""
    row = df.agg(*[F.percentile(clean(c), F.array(*[F.lit(float(q)) for q in at])).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


@dataclass
class StandardScaler(Transformer):
    """(x - mean) / population deviation; a deviation under 1e-10 isn't divided by."""

    with_mean: bool = True
    with_std: bool = True
    columns: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)

    def fit(self, df, columns):
        self.columns, self.state = tuple(columns), aggregate(df, columns, mean=F.avg, std=F.stddev_pop)
        return self

    def _parts(self, c):
        s = self.state[c]
        return s["mean"] if self.with_mean else 0.0, s["std"] if self.with_std and s["std"] > TINY else 1.0

    def expressions(self):
        return {c: (clean(c) - self._parts(c)[0]) / self._parts(c)[1] for c in self.columns}

    def inverse_expressions(self):
        return {c: clean(c) * self._parts(c)[1] + self._parts(c)[0] for c in self.columns}


@dataclass
class MinMaxScaler(Transformer):
    """To a range; a constant column goes to the range's lower end."""

    low: float = 0.0
    high: float = 1.0
    columns: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)

    def fit(self, df, columns):
        self.columns, self.state = tuple(columns), aggregate(df, columns, min=F.min, max=F.max)
        return self

    def expressions(self):
        made = {}
        for c in self.columns:
            a, b = self.state[c]["min"], self.state[c]["max"]
            made[c] = (clean(c) - a) / (b - a) * (self.high - self.low) + self.low if b - a > TINY else F.when(clean(c).isNotNull(), F.lit(self.low))
        return made

    def inverse_expressions(self):
        return {c: (clean(c) - self.low) / (self.high - self.low) * (s["max"] - s["min"]) + s["min"] for c, s in self.state.items()}


@dataclass
class RobustScaler(Transformer):
    """(x - median) / quantile range; a zero range only centres."""

    centering: bool = True
    scaling: bool = True
    quantile_range: tuple[float, float] = (25.0, 75.0)
    columns: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)

    def fit(self, df, columns):
        a, b = self.quantile_range
        self.columns, self.state = tuple(columns), quantiles(df, columns, [a / 100, 0.5, b / 100])
        return self

    def _parts(self, c):
        low, mid, high = self.state[c]
        return mid if self.centering else 0.0, high - low if self.scaling and high - low > TINY else 1.0

    def expressions(self):
        return {c: (clean(c) - self._parts(c)[0]) / self._parts(c)[1] for c in self.columns}

    def inverse_expressions(self):
        return {c: clean(c) * self._parts(c)[1] + self._parts(c)[0] for c in self.columns}


@dataclass
class MaxAbsScaler(Transformer):
    """x / max |x|."""

    columns: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)

    def fit(self, df, columns):
        self.columns = tuple(columns)
        self.state = {c: s["max"] if s["max"] and s["max"] > TINY else 1.0 for c, s in aggregate(df, columns, max=lambda x: F.max(F.abs(x))).items()}
        return self

    def expressions(self):
        return {c: clean(c) / self.state[c] for c in self.columns}

    def inverse_expressions(self):
        return {c: clean(c) * self.state[c] for c in self.columns}


@dataclass
class Normalizer(Transformer):
    """Rows of norm 1 (l1, l2 or max); rows of norm up to 1e-15 stay."""

    norm: str = "l2"
    columns: tuple[str, ...] = ()

    def fit(self, df, columns):
        if self.norm not in ("l1", "l2", "max"):
            raise InvalidInput(f"no norm {self.norm}")
        self.columns = tuple(columns)
        return self

    def expressions(self):
        parts = [F.coalesce(clean(c), F.lit(0.0)) for c in self.columns]
        if self.norm == "l2":
            size = F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
        elif self.norm == "l1":
            size = sum((F.abs(p) for p in parts), F.lit(0.0))
        else:
            size = F.greatest(F.lit(0.0), *[F.abs(p) for p in parts])
        return {c: F.when(size > 1e-15, clean(c) / size).otherwise(clean(c)) for c in self.columns}


@dataclass
class Binarizer(Transformer):
    """1 above the threshold, else 0."""

    threshold: float = 0.0
    columns: tuple[str, ...] = ()

    def fit(self, df, columns):
        self.columns = tuple(columns)
        return self

    def expressions(self):
        return {c: F.when(clean(c).isNotNull(), F.when(clean(c) > self.threshold, 1.0).otherwise(0.0)) for c in self.columns}


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < TINY else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < TINY else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < TINY else (F.pow(x, F.lit(lam)) - 1) / lam


@dataclass
class PowerTransformer(Transformer):
    """Box-Cox or Yeo-Johnson with the lambda of greatest likelihood, by golden section.

    A round evaluates a whole bracket of lambdas for all columns in one job.
    """

    method: str = "yeo-johnson"
    standardize: bool = True
    lambdas: dict = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)

    def _f(self, x, lam):
        return yeo_johnson(x, lam) if self.method == "yeo-johnson" else box_cox(x, lam)

    def fit(self, df, columns, points: int = 9, tolerance: float = 1e-8):
        self.columns = tuple(columns)
        if self.method == "box-cox" and any((s["min"] or 0) <= 0 for s in aggregate(df, columns, min=F.min).values()):
            raise InvalidInput("Box-Cox needs positive values")
        if not self.lambdas:
            jacobian = (lambda x: F.sum(F.signum(x) * F.log1p(F.abs(x)))) if self.method == "yeo-johnson" else (lambda x: F.sum(F.ln(x)))
            fixed = aggregate(df, columns, n=F.count, j=jacobian)
            span = {c: (-5.0, 5.0) for c in columns}
            while max(b - a for a, b in span.values()) > tolerance:
                grid = {c: [a + (b - a) * i / (points - 1) for i in range(points)] for c, (a, b) in span.items()}
                row = df.agg(*[F.var_pop(self._f(clean(c), lam)).alias(f"{c}:{i}") for c in columns for i, lam in enumerate(grid[c])]).first()
                for c in columns:
                    score = [-fixed[c]["n"] / 2 * math.log(max(row[f"{c}:{i}"], 1e-300)) + (lam - 1) * fixed[c]["j"] for i, lam in enumerate(grid[c])]
                    best = max(range(points), key=score.__getitem__)
                    span[c] = grid[c][max(best - 1, 0)], grid[c][min(best + 1, points - 1)]
            self.lambdas = {c: (a + b) / 2 for c, (a, b) in span.items()}
        if self.standardize:
            row = df.agg(*[f(self._f(clean(c), self.lambdas[c])).alias(f"{n}:{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
            self.state = {c: (row[f"mean:{c}"], row[f"std:{c}"] if row[f"std:{c}"] > TINY else 1.0) for c in columns}
        return self

    def expressions(self):
        made = {c: self._f(clean(c), self.lambdas[c]) for c in self.columns}
        return {c: (x - self.state[c][0]) / self.state[c][1] for c, x in made.items()} if self.standardize else made

    def inverse_expressions(self):
        made = {}
        for c in self.columns:
            y, lam = clean(c), self.lambdas[c]
            if self.standardize:
                y = y * self.state[c][1] + self.state[c][0]
            if self.method == "box-cox":
                made[c] = F.exp(y) if abs(lam) < TINY else F.pow(y * lam + 1, F.lit(1 / lam))
            else:
                up = F.expm1(y) if abs(lam) < TINY else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
                down = 1 - F.exp(-y) if abs(lam - 2) < TINY else 1 - F.pow(1 - (2 - lam) * y, F.lit(1 / (2 - lam)))
                made[c] = F.when(y >= 0, up).otherwise(down)
        return made


@dataclass
class QuantileTransformer(Transformer):
    """Ranks on a quantile grid, uniform or normal, clipped to 1e-7 at the ends."""

    output: str = "uniform"
    n_quantiles: int = 1000
    columns: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)

    def fit(self, df, columns):
        self.columns = tuple(columns)
        n = max(2, min(self.n_quantiles, df.count()))
        self.state = quantiles(df, columns, [i / (n - 1) for i in range(n)])
        return self

    def expressions(self):
        made = {}
        for c in self.columns:
            grid, x, n = self.state[c], clean(c), len(self.state[c])
            q = F.array(*[F.lit(v) for v in grid])
            # the first point at or above x, by a fold over the grid's literals
            above = F.aggregate(F.transform(q, lambda v: (v < x).cast("int")), F.lit(0), lambda a, b: a + b)
            low, high = F.element_at(q, F.greatest(above, F.lit(1))), F.element_at(q, F.least(above + 1, F.lit(n)))
            ties = F.aggregate(F.transform(q, lambda v: (v == x).cast("int")), F.lit(0), lambda a, b: a + b)
            inside = F.when(ties > 1, above + (ties - 1) / 2).when(high > low, above - 1 + (x - low) / (high - low)).otherwise(above.cast("double"))
            p = F.when(x <= grid[0], 1e-7).when(x >= grid[-1], 1 - 1e-7).otherwise(F.least(F.greatest(inside / (n - 1), F.lit(1e-7)), F.lit(1 - 1e-7)))
            made[c] = F.when(x.isNotNull(), p if self.output == "uniform" else normal_score(p))
        return made


def normal_score(p: Column) -> Column:
    """The normal quantile by interpolation between tabled probabilities (error under 1e-4 within 1e-7 .. 1 - 1e-7)."""
    at = [1e-7, 1e-6, 1e-5, 1e-4, *[i / 1000 for i in range(1, 10)], *[i / 200 for i in range(2, 100)], 0.5]
    z = [normal_quantile(v) for v in at]
    small = F.least(p, 1 - p)
    value = F.lit(0.0)
    for a, b, za, zb in reversed(list(zip(at, at[1:], z, z[1:]))):
        # linear in log p below one percent, in p above
        part = za + (zb - za) * ((F.ln(small) - math.log(a)) / (math.log(b) - math.log(a)) if b <= 0.01 else (small - a) / (b - a))
        value = F.when(small < b, part).otherwise(value)
    return F.when(p < 0.5, value).otherwise(-value)


@dataclass
class KBinsDiscretizer(Transformer):
    """Bins by equal width, quantiles or one-dimensional k-means; ordinal or one-hot."""

    n_bins: int = 5
    strategy: str = "uniform"
    encode: str = "ordinal"
    columns: tuple[str, ...] = ()
    edges: dict = field(default_factory=dict)

    def fit(self, df, columns):
        self.columns, k = tuple(columns), self.n_bins
        if self.strategy == "quantile":
            found = quantiles(df, columns, [i / k for i in range(k + 1)])
            self.edges = {c: _apart(v) for c, v in found.items()}
            return self
        ends = aggregate(df, columns, min=F.min, max=F.max)
        self.edges = {c: [s["min"] + (s["max"] - s["min"]) * i / k for i in range(k)] + [s["max"]] for c, s in ends.items()}
        if self.strategy == "kmeans":
            for c in columns:
                self.edges[c] = _apart(self._kmeans(df, c, self.edges[c]))
        elif self.strategy != "uniform":
            raise InvalidInput(f"no strategy {self.strategy}")
        return self

    def _kmeans(self, df, c, edges):
        centres = [(a + b) / 2 for a, b in zip(edges, edges[1:])]
        values = df.groupBy(clean(c).alias("v")).agg(F.count("*").alias("n")).filter("v IS NOT NULL").persist()
        try:
            for _ in range(100):
                cuts = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
                found = {r["b"]: r["m"] for r in values.groupBy(_bin("v", [edges[0], *cuts, edges[-1]]).alias("b")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).collect()}
                moved = [found.get(float(i), m) for i, m in enumerate(centres)]
                step = max(abs(a - b) for a, b in zip(moved, centres))
                centres = moved
                if step < 1e-8:
                    break
        finally:
            values.unpersist()
        return [edges[0], *[(a + b) / 2 for a, b in zip(centres, centres[1:])], edges[-1]]

    def expressions(self):
        bins = {c: _bin(c, self.edges[c]) for c in self.columns}
        if self.encode == "ordinal":
            return bins
        return {f"{c}_{i}": F.when(b == i, 1.0).otherwise(0.0) for c, b in bins.items() for i in range(len(self.edges[c]) - 1)}

    def inverse_expressions(self):
        return {c: F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip(self.edges[c], self.edges[c][1:])]), clean(c).cast("int") + 1) for c in self.columns}


def _apart(edges: Sequence[float]) -> list[float]:
    kept = [edges[0]]
    for e in edges[1:]:
        if e - kept[-1] > TINY:
            kept.append(e)
    return kept if len(kept) > 1 else [kept[0], kept[0] + 1]


def _bin(c: str, edges: Sequence[float]) -> Column:
    """The number of edges up to x, less one; the first bin below and the last above."""
    x = clean(c)
    value = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= edges[0], 0.0).when(x >= edges[-1], float(len(edges) - 2))
    for i in range(len(edges) - 2, 0, -1):
        value = value.when(x >= edges[i], float(i))
    return value.otherwise(0.0)


@dataclass
class PolynomialFeatures(Transformer):
    """All monomials up to a degree, bias first, lexicographic within a degree."""

    degree: int = 2
    interaction_only: bool = False
    include_bias: bool = True
    columns: tuple[str, ...] = ()

    def fit(self, df, columns):
        self.columns = tuple(columns)
        return self

    def terms(self) -> dict[str, tuple[str, ...]]:
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        found = {"1": ()} if self.include_bias else {}
        for d in range(1, self.degree + 1):
            for term in pick(self.columns, d):
                name = " ".join(c if n == 1 else f"{c}^{n}" for c, n in ((c, term.count(c)) for c in dict.fromkeys(term)))
                found[name] = term
        return found

    def expressions(self):
        return {name: math.prod((clean(c) for c in term), start=F.lit(1.0)) for name, term in self.terms().items()}


@dataclass
class SimpleImputer(Transformer):
    """Missing values by mean, median, most frequent value (ties to the smallest) or a constant."""

    strategy: str = "mean"
    fill_value: float = 0.0
    indicator: bool = False
    columns: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)

    def fit(self, df, columns):
        self.columns = tuple(columns)
        if self.strategy == "constant":
            found = dict.fromkeys(columns, self.fill_value)
        elif self.strategy == "most_frequent":
            from tessella.frame import stacked

            counts = stacked(df, columns).filter("value IS NOT NULL").groupBy("feature", F.round("value", 10).alias("value")).count()
            found = {r["feature"]: r["v"] for r in counts.groupBy("feature").agg(F.max_by("value", F.struct("count", -F.col("value"))).alias("v")).collect()}
        else:
            middle = F.avg if self.strategy == "mean" else lambda x: F.percentile(x, F.lit(0.5))
            found = {c: s["v"] for c, s in aggregate(df, columns, v=middle).items()}
        self.state = {c: self.fill_value if found.get(c) is None else found[c] for c in columns}
        return self

    def expressions(self):
        made = {c: F.coalesce(clean(c), F.lit(float(self.state[c]))) for c in self.columns}
        if self.indicator:
            made |= {f"{c}_missing": clean(c).isNull().cast("double") for c in self.columns}
        return made


@dataclass
class KNNImputer(Transformer):
    """Missing values from the k nearest rows that have them.

    Distances skip missing coordinates and are scaled by all over present ones. Rows
    with gaps meet all donors; donors are broadcast up to ``broadcast_rows``.
    """

    k: int = 5
    weights: str = "uniform"
    row_id: str = "id"
    broadcast_rows: int = 100_000
    columns: tuple[str, ...] = ()

    def fit(self, df, columns):
        self.columns = tuple(columns)
        self._donors = df.select(self.row_id, *[clean(c).alias(c) for c in columns])
        self._means = aggregate(df, columns, mean=F.avg)
        self._small = df.count() <= self.broadcast_rows
        return self

    def transform(self, df):
        gaps = df.filter(" OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in self.columns)).select(F.col(self.row_id).alias("__q"), *[clean(c).alias(f"__{c}") for c in self.columns])
        donors = F.broadcast(self._donors) if self._small else self._donors
        pairs = gaps.join(donors, F.col("__q") != F.col(self.row_id))
        both = [(F.col(f"__{c}").isNotNull() & F.col(c).isNotNull()) for c in self.columns]
        square = sum((F.when(b, (F.col(f"__{c}") - F.col(c)) ** 2).otherwise(0.0) for b, c in zip(both, self.columns)), F.lit(0.0))
        valid = sum((b.cast("int") for b in both), F.lit(0))
        pairs = pairs.withColumn("__d", F.when(valid > 0, F.sqrt(square * len(self.columns) / valid)))
        filled = df
        for c in self.columns:
            order = Window.partitionBy("__q").orderBy("__d", self.row_id)
            near = pairs.filter(F.col(f"__{c}").isNull() & F.col(c).isNotNull() & F.col("__d").isNotNull()).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= self.k)
            w = F.lit(1.0) if self.weights == "uniform" else 1 / (F.col("__d") + 1e-10)
            value = near.groupBy("__q").agg((F.sum(w * F.col(c)) / F.sum(w)).alias("__v"))
            filled = filled.join(value, filled[self.row_id] == F.col("__q"), "left").withColumn(c, F.coalesce(clean(c), "__v", F.lit(self._means[c]["mean"]))).drop("__q", "__v")
        return filled


@dataclass
class OneHotEncoder(Transformer):
    """A 0/1 column per category, in sorted order; drop none, first, or one of two (if_binary).

    The categories become columns, so ``max_categories`` guards their number.
    """

    drop: str = "none"
    handle_unknown: str = "error"
    max_categories: int = 1000
    columns: tuple[str, ...] = ()
    categories: dict = field(default_factory=dict)

    def fit(self, df, columns):
        self.columns = tuple(columns)
        row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
        self.categories = {c: list(row[c]) for c in columns}
        many = [c for c, v in self.categories.items() if len(v) > self.max_categories]
        if many:
            raise InvalidInput(f"too many categories: {many}")
        return self

    def names(self) -> dict[str, tuple[str, object]]:
        made = {}
        for c in self.columns:
            values = self.categories[c]
            skip = 1 if self.drop == "first" or self.drop == "if_binary" and len(values) == 2 else 0
            made |= {f"{c}_{v}": (c, v) for v in values[skip:]}
        return made

    def expressions(self):
        made = {}
        for name, (c, v) in self.names().items():
            known = F.col(c).isin(*self.categories[c])
            other = F.lit(0.0) if self.handle_unknown == "ignore" else F.when(known, 0.0).otherwise(F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), F.col(c).cast("string"))).cast("double"))
            made[name] = F.when(F.col(c) == F.lit(v), 1.0).otherwise(other)
        return made


@dataclass
class OrdinalEncoder(Transformer):
    """Codes by first appearance in ``order``; unknown values are -1 or an error."""

    order: tuple[str, ...] = ()
    handle_unknown: str = "error"
    broadcast_categories: int = 100_000
    columns: tuple[str, ...] = ()

    def fit(self, df, columns):
        self.columns = tuple(columns)
        self._codes = {}
        for c in columns:
            first = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(F.struct(*self.order)).alias("__first"))
            codes = first.select(F.col(c).alias("__value"), (F.row_number().over(Window.orderBy("__first")) - 1).cast("double").alias("__code"))
            self._codes[c] = codes, codes.count() <= self.broadcast_categories
        return self

    def transform(self, df):
        for c, (codes, small) in self._codes.items():
            joined = df.join(F.broadcast(codes) if small else codes, F.col(c) == F.col("__value"), "left")
            unknown = F.lit(-1.0) if self.handle_unknown == "use_minus_one" else F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit(f"unknown category of {c}")).cast("double"))
            df = joined.withColumn(c, F.coalesce("__code", unknown)).drop("__value", "__code")
        return df


@dataclass
class LabelEncoder:
    """A column's sorted values as 0 .. k-1."""

    def fit(self, df: DataFrame, column: str) -> LabelEncoder:
        self.column = column
        self.classes = df.filter(F.col(column).isNotNull()).select(column).distinct().select(F.col(column).alias("class"), (F.row_number().over(Window.orderBy(column)) - 1).alias("label"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.classes, df[self.column] == F.col("class"), "left").drop("class")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.classes, "label", "left")


@dataclass
class TargetEncoder:
    """Categories as smoothed target means; out-of-fold for training rows.

    The k folds are contiguous blocks of ``order``. A fold's category sums are the
    totals less its own, so one grouped aggregate serves all folds.
    """

    smooth: float = 1.0
    cv: int = 5

    def _mean(self, total: Column, n: Column, overall: Column) -> Column:
        return (total + self.smooth * overall) / (n + self.smooth)

    def fit(self, df: DataFrame, column: str, target: str) -> TargetEncoder:
        self.column = column
        self.overall = df.agg(F.avg(clean(target))).first()[0]
        sums = df.groupBy(F.col(column).alias("__value")).agg(F.sum(clean(target)).alias("t"), F.count(target).alias("n"))
        self.encoding = sums.select("__value", self._mean(F.col("t"), F.col("n"), F.lit(self.overall)).alias("__code"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.encoding, F.col(self.column).eqNullSafe(F.col("__value")), "left").withColumn(f"{self.column}_encoded", F.coalesce("__code", F.lit(self.overall))).drop("__value", "__code")

    def fit_transform(self, df: DataFrame, column: str, target: str, order: Sequence[str]) -> DataFrame:
        self.fit(df, column, target)
        from tessella.operators.splits import kfold

        folded = kfold(df, self.cv, order, "__fold")
        y = clean(target)
        by = folded.groupBy("__fold", F.col(column).alias("__value")).agg(F.sum(y).alias("t"), F.count(target).alias("n"))
        all_of, of_fold, every = Window.partitionBy("__value"), Window.partitionBy("__fold"), Window.partitionBy()
        by = by.withColumn("ot", F.sum("t").over(all_of) - F.col("t")).withColumn("on", F.sum("n").over(all_of) - F.col("n"))
        by = by.withColumn("g", (F.sum("t").over(every) - F.sum("t").over(of_fold)) / (F.sum("n").over(every) - F.sum("n").over(of_fold)))
        codes = by.select("__fold", "__value", self._mean(F.col("ot"), F.col("on"), F.col("g")).alias(f"{column}_encoded"))
        return folded.join(codes, (folded["__fold"] == codes["__fold"]) & F.col(column).eqNullSafe(F.col("__value"))).drop("__fold", "__value")


@dataclass
class VarianceThreshold(Transformer):
    """Columns whose population variance is above the threshold."""

    threshold: float = 0.0
    columns: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()

    def fit(self, df, columns):
        found = aggregate(df, columns, v=F.var_pop)
        self.columns = tuple(c for c in columns if (found[c]["v"] or 0.0) > self.threshold)
        self.dropped = tuple(c for c in columns if c not in self.columns)
        if not self.columns:
            raise InvalidInput("no column varies enough")
        return self

    def transform(self, df):
        return df.drop(*self.dropped)
