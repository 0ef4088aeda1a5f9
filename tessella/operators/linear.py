"""Linear models from sufficient statistics: sums of products in one aggregate, algebra on the driver.

Iterated models (logistic, robust, quantile, SGD) run one aggregate a round over a
cached input; only p-by-p sums come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import clean, exact_quantile
from tessella.functions import specfun as sf


def product_sums(df: DataFrame, left: Sequence[Column], weight: Column | None = None, by: str | None = None):
    """Sums of all products of the expressions: a matrix, or one for each value of ``by``."""
    w = F.lit(1.0) if weight is None else weight
    named = df.select(*([F.col(by).alias("__by")] if by else []), w.alias("__w"), *[x.alias(f"__{i}") for i, x in enumerate(left)])
    k = len(left)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # one array column: wide aggregates beyond the codegen limit stay one operator
    sums = [F.coalesce(F.sum(F.col("__w") * F.col(f"__{i}") * F.col(f"__{j}")), F.lit(0.0)) for i, j in pairs]
    found = named.groupBy(*(["__by"] if by else [])).agg(F.array(*sums).alias("s")).collect()

    def matrix(row):
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, row["s"]):
            m[i, j] = m[j, i] = v
        return m

    return {r["__by"]: matrix(r) for r in found} if by else matrix(found[0])


def design(columns: Sequence[str], intercept: bool) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [clean(c) for c in columns]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError as error:
        raise InvalidInput("the columns are linearly dependent") from error


class LinearModel:
    """Columns, coefficients and an intercept; predictions are an expression."""

    columns: tuple[str, ...]
    coefficients: list[float]
    intercept: float

    def expression(self) -> Column:
        return sum((clean(c) * float(b) for c, b in zip(self.columns, self.coefficients)), F.lit(float(self.intercept)))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.expression())

    def _set(self, columns, beta, intercept):
        self.columns = tuple(columns)
        self.intercept = float(beta[0]) if intercept else 0.0
        self.coefficients = [float(b) for b in (beta[1:] if intercept else beta)]
        return self


@dataclass
class LinearRegression(LinearModel):
    """Least squares with standard errors, t and F tests, information criteria, leverage and Cook's distance."""

    fit_intercept: bool = True
    confidence: float = 0.95
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, df: DataFrame, columns: Sequence[str], target: str) -> LinearRegression:
        x = design(columns, self.fit_intercept)
        m = product_sums(df.filter(clean(target).isNotNull()), [*x, clean(target), *([] if self.fit_intercept else [F.lit(1.0)])])
        p = len(x)
        g, v, yy = m[:p, :p], m[:p, p], m[p, p]
        n, sum_y = (m[0, 0], m[0, p]) if self.fit_intercept else (m[p + 1, p + 1], m[p, p + 1])
        if n <= p:
            raise InvalidInput("more rows than coefficients are needed")
        scale = np.sqrt(np.diag(g))
        if np.linalg.cond(g / np.outer(scale, scale)) > 1e14:
            raise InvalidInput("the columns are linearly dependent")
        inverse = np.linalg.inv(g / np.outer(scale, scale)) / np.outer(scale, scale)
        beta = inverse @ v
        self._set(columns, beta, self.fit_intercept)
        rss = max(float(yy - beta @ v), 0.0)
        tss = float(yy - sum_y**2 / n) if self.fit_intercept else float(yy)
        self.n, self.df, self.rss, self.sigma2 = int(n), int(n - p), rss, rss / (n - p)
        self.covariance = self.sigma2 * inverse
        self.inverse = inverse
        self.standard_errors = np.sqrt(np.diag(self.covariance)).tolist()
        self.t_values = [float(b / s) if s else math.inf for b, s in zip(beta, self.standard_errors)]
        self.p_values = [sf.t_two_sided(t, self.df) for t in self.t_values]
        half = sf.t_quantile(0.5 + self.confidence / 2, self.df)
        self.intervals = [(float(b - half * s), float(b + half * s)) for b, s in zip(beta, self.standard_errors)]
        k = p - self.fit_intercept
        self.r2 = 1 - rss / tss if tss else (1.0 if not rss else 0.0)
        self.adjusted_r2 = 1 - (1 - self.r2) * (n - self.fit_intercept) / self.df
        self.f_statistic = (tss - rss) / k / self.sigma2 if k and self.sigma2 else math.inf
        self.f_p_value = sf.f_upper(self.f_statistic, k, self.df) if k else 1.0
        like = -n / 2 * (math.log(2 * math.pi * max(rss / n, 1e-300)) + 1)
        self.aic, self.bic = 2 * (p + 1) - 2 * like, math.log(n) * (p + 1) - 2 * like
        return self

    def leverage(self) -> Column:
        x = design(self.columns, self.fit_intercept)
        return sum((x[i] * x[j] * float(self.inverse[i, j]) for i in range(len(x)) for j in range(len(x))), F.lit(0.0))

    def diagnose(self, df: DataFrame, target: str) -> DataFrame:
        """prediction, residual, leverage, studentised residual, Cook's distance and whether it exceeds 4/n."""
        p = len(self.coefficients) + self.fit_intercept
        out = df.withColumn("prediction", self.expression()).withColumn("residual", clean(target) - F.col("prediction")).withColumn("leverage", self.leverage())
        student = F.col("residual") / F.sqrt(self.sigma2 * (1 - F.col("leverage")))
        out = out.withColumn("studentized", student).withColumn("cooks_distance", F.col("studentized") ** 2 * F.col("leverage") / (1 - F.col("leverage")) / p)
        return out.withColumn("influential", F.col("cooks_distance") > 4 / self.n)

    def predict_interval(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        half = sf.t_quantile(0.5 + level / 2, self.df) * F.sqrt(self.sigma2 * (1 + self.leverage()))
        return self.predict(df).withColumn("lower", F.col("prediction") - half).withColumn("upper", F.col("prediction") + half)


@dataclass(frozen=True)
class Centred:
    """n, means and centred sums of squares and products of columns and a target."""

    n: float
    mean_x: np.ndarray
    mean_y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def of(cls, m: np.ndarray, intercept: bool = True) -> Centred:
        """From the product matrix of (1, x.., y)."""
        n, s = m[0, 0], m[0, 1:]
        if intercept:
            c = m[1:, 1:] - np.outer(s, s) / n
            return cls(n, s[:-1] / n, s[-1] / n, c[:-1, :-1], c[:-1, -1], c[-1, -1])
        c = m[1:, 1:]
        return cls(n, np.zeros(len(s) - 1), 0.0, c[:-1, :-1], c[:-1, -1], c[-1, -1])


def _gram(df: DataFrame, columns: Sequence[str], target: str, by: str | None = None):
    return product_sums(df, [F.lit(1.0), *[clean(c) for c in columns], clean(target)], by=by)


def ridge_solution(c: Centred, alpha: float) -> np.ndarray:
    return solve(c.xx + alpha * np.eye(len(c.xy)), c.xy)


def elastic_net_solution(c: Centred, alpha: float, l1_ratio: float, start: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """Coordinate descent on (1/2n) |y - Xb|^2 + alpha (r |b|_1 + (1 - r)/2 |b|^2), from the products alone."""
    beta = np.zeros(len(c.xy)) if start is None else start.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(beta)):
            old = beta[j]
            rho = (c.xy[j] - c.xx[j] @ beta + c.xx[j, j] * old) / c.n
            norm = c.xx[j, j] / c.n + l2
            beta[j] = math.copysign(max(abs(rho) - l1, 0.0), rho) / norm if norm > 0 else 0.0
            moved = max(moved, abs(beta[j] - old))
        if moved < tol:
            break
    return beta


def alpha_path(c: Centred, l1_ratio: float = 1.0, n: int = 100, eps: float = 1e-3) -> list[float]:
    top = float(np.abs(c.xy).max() / c.n / max(l1_ratio, 1e-3))
    return [top * eps ** (i / (n - 1)) for i in range(n)] if n > 1 else [top]


class _Penalised(LinearModel):
    fit_intercept: bool

    def _from(self, columns, c: Centred, beta):
        self.columns, self.coefficients = tuple(columns), [float(b) for b in beta]
        self.intercept = float(c.mean_y - c.mean_x @ beta) if self.fit_intercept else 0.0
        return self


@dataclass
class Ridge(_Penalised):
    alpha: float = 1.0
    fit_intercept: bool = True
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, df, columns, target):
        c = Centred.of(_gram(df, columns, target), self.fit_intercept)
        self.effective_df = float(np.trace(solve(c.xx + self.alpha * np.eye(len(c.xy)), c.xx))) + self.fit_intercept
        return self._from(columns, c, ridge_solution(c, self.alpha))


@dataclass
class ElasticNet(_Penalised):
    alpha: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True
    max_iter: int = 1000
    tol: float = 1e-6
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, df, columns, target):
        c = Centred.of(_gram(df, columns, target), self.fit_intercept)
        return self._from(columns, c, elastic_net_solution(c, self.alpha, self.l1_ratio, None, self.max_iter, self.tol))


def Lasso(alpha: float = 1.0, **options) -> ElasticNet:
    return ElasticNet(alpha=alpha, l1_ratio=1.0, **options)


def regularisation_path(df: DataFrame, columns: Sequence[str], target: str, alphas: Sequence[float] | None = None, l1_ratio: float = 1.0, n: int = 100) -> list[tuple[float, list[float]]]:
    """(alpha, coefficients) from one aggregate; each solution starts at the one before."""
    c = Centred.of(_gram(df, columns, target))
    out, beta = [], None
    for alpha in sorted(alphas or alpha_path(c, l1_ratio, n), reverse=True):
        beta = elastic_net_solution(c, alpha, l1_ratio, beta)
        out.append((alpha, beta.tolist()))
    return out


@dataclass
class PenalisedCV(_Penalised):
    """Ridge (l1_ratios empty) or elastic net with the penalty of least cross-validated error.

    One aggregate by fold serves all: a fold's training sums are the totals less its own.
    """

    alphas: tuple[float, ...] = ()
    l1_ratios: tuple[float, ...] = ()
    folds: int = 5
    n_alphas: int = 50
    fit_intercept: bool = True
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, df: DataFrame, columns: Sequence[str], target: str, order: Sequence[str]) -> PenalisedCV:
        from tessella.operators.splits import kfold

        sums = _gram(kfold(df, self.folds, order, "__fold"), columns, target, by="__fold")
        total = sum(sums.values())
        everything = Centred.of(total, self.fit_intercept)
        ratios = self.l1_ratios or (None,)
        self.scores = {}
        for ratio in ratios:
            alphas = self.alphas or ((0.1, 1.0, 10.0) if ratio is None else alpha_path(everything, ratio, self.n_alphas))
            for own in sums.values():
                c, beta = Centred.of(total - own, self.fit_intercept), None
                for alpha in sorted(alphas, reverse=True):
                    beta = ridge_solution(c, alpha) if ratio is None else elastic_net_solution(c, alpha, ratio, beta)
                    b = np.concatenate(([c.mean_y - c.mean_x @ beta if self.fit_intercept else 0.0], beta, [-1.0]))
                    self.scores[ratio, alpha] = self.scores.get((ratio, alpha), 0.0) + float(b @ own @ b) / own[0, 0] / self.folds
        self.l1_ratio, self.alpha = min(self.scores, key=self.scores.get)
        beta = ridge_solution(everything, self.alpha) if self.l1_ratio is None else elastic_net_solution(everything, self.alpha, self.l1_ratio)
        return self._from(columns, everything, beta)


@dataclass
class RidgeClassifier:
    """One ridge on +1/-1 per class from shared products; the greatest score wins."""

    alpha: float = 1.0

    def fit(self, df: DataFrame, columns: Sequence[str], target: str) -> RidgeClassifier:
        self.columns = tuple(columns)
        self.classes = [r[0] for r in df.select(target).distinct().orderBy(target).collect()]
        signs = [F.when(F.col(target) == F.lit(c), 1.0).otherwise(-1.0) for c in self.classes]
        m = product_sums(df, [F.lit(1.0), *[clean(c) for c in columns], *signs])
        p = len(columns)
        self.models = []
        for k in range(len(self.classes)):
            pick = [*range(p + 1), p + 1 + k]
            c = Centred.of(m[np.ix_(pick, pick)])
            self.models.append(Ridge(self.alpha)._from(columns, c, ridge_solution(c, self.alpha)))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", argmax([m.expression() for m in self.models], self.classes))


def argmax(scores: Sequence[Column], labels: Sequence) -> Column:
    """The label of the greatest score, the first on ties."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(labels[-1])
    for s, label in reversed(list(zip(scores[:-1], labels[:-1]))):
        out = F.when(s >= best, F.lit(label)).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0))))


@dataclass
class LogisticRegression(LinearModel):
    """Binary, by iteratively reweighted least squares: one aggregate a round."""

    fit_intercept: bool = True
    l2: float = 0.0
    max_iter: int = 100
    tol: float = 1e-8
    balanced: bool = False
    confidence: float = 0.95
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, df: DataFrame, columns: Sequence[str], target: str) -> LogisticRegression:
        counts = {r[0]: r[1] for r in df.groupBy(F.col(target).cast("double")).count().collect()}
        if set(counts) != {0.0, 1.0}:
            raise InvalidInput("the target must hold 0 and 1")
        n = sum(counts.values())
        weight = F.when(F.col(target) > 0.5, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0])) if self.balanced else F.lit(1.0)
        p = len(columns) + self.fit_intercept
        l2 = self.l2 or (1e-4 if n < p else 0.0)
        penalty = np.diag([0.0] * self.fit_intercept + [l2] * len(columns))
        rows = df.select(clean(target).alias("__y"), weight.alias("__c"), *[clean(c).alias(c) for c in columns]).persist()
        beta = np.zeros(p)
        x = design(columns, self.fit_intercept)
        try:
            for self.iterations in range(1, self.max_iter + 1):
                eta = sum((v * float(b) for v, b in zip(x, beta)), F.lit(0.0))
                mu = sigmoid(eta)
                var = F.least(F.greatest(mu * (1 - mu), F.lit(1e-10)), F.lit(0.25))
                m = product_sums(rows, [*x, eta + (F.col("__y") - mu) / var], var * F.col("__c"))
                self.hessian = m[:p, :p] + penalty
                new = solve(self.hessian, m[:p, p])
                moved, beta = np.abs(new - beta).max(), new
                if moved < self.tol:
                    break
        finally:
            rows.unpersist()
        self._set(columns, beta, self.fit_intercept)
        self.covariance = np.linalg.inv(self.hessian)
        se = np.sqrt(np.diag(self.covariance))
        self.standard_errors = se.tolist()
        self.z_values = (beta / se).tolist()
        self.p_values = [sf.normal_two_sided(z) for z in self.z_values]
        half = sf.normal_quantile(0.5 + self.confidence / 2)
        self.odds_ratios = [(math.exp(b), math.exp(b - half * s), math.exp(b + half * s)) for b, s in zip(beta, se)] if np.abs(beta).max() < 300 else []
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", sigmoid(self.expression()))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, F.when(sigmoid(self.expression()) >= 0.5, 1.0).otherwise(0.0))


def robust_weight(u: Column, kind: str, c: float | None = None) -> Column:
    """The weight of a residual in units of scale."""
    a = F.abs(u)
    if kind == "huber":
        k = c or 1.345
        return F.when(a <= k, 1.0).otherwise(k / a)
    if kind == "bisquare":
        k = c or 4.685
        return F.when(a <= k, (1 - (u / k) ** 2) ** 2).otherwise(0.0)
    if kind == "andrews":
        k = c or 1.339
        return F.when(a < 1e-12, 1.0).when(a <= k * math.pi, F.sin(u / k) / (u / k)).otherwise(0.0)
    if kind == "hampel":
        k1, k2, k3 = (x * (c or 1.0) for x in (2.0, 4.0, 8.0))
        return F.when(a <= k1, 1.0).when(a <= k2, k1 / a).when(a <= k3, k1 * (k3 - a) / (a * (k3 - k2))).otherwise(0.0)
    raise InvalidInput(f"no estimator {kind}")


#: Numbers that the driver holds of rows near the medians.
NEAR = 2_000_000


class Medians:
    """The median of residuals and the median distance from it, for one fit after another.

    A step moves a residual by no more than the columns' ranges allow. So rows far from
    the median, and from one deviation around it, stay on their side of both and are
    counted; the others are held on the driver, if they are few, and decide both exactly
    without another pass. What the held rows can't decide comes from all rows.
    """

    def __init__(self, rows: DataFrame, x: Sequence[Column], target: str):
        self.rows, self.x, self.y = rows, list(x), F.col(target)
        self.last = self.held = None
        ends = rows.agg(*[f(v) for v in (self.y, *self.x) for f in (F.min, F.max)]).first()
        self.least, self.most = np.array(ends[0::2], float), np.array(ends[1::2], float)

    def residual(self, beta: np.ndarray) -> Column:
        return self.y - sum((v * float(b) for v, b in zip(self.x, beta)), F.lit(0.0))

    def of(self, beta: np.ndarray) -> tuple[float, float]:
        found = self._decided(beta)
        if not found and self.last:
            self._hold(beta)
            found = self._decided(beta)
        if not found:
            e = self.residual(beta)
            middle = exact_quantile(self.rows, e)
            found = middle, exact_quantile(self.rows, F.abs(e - middle))
        self.last = beta, *found
        return found

    def _moves(self, step: np.ndarray) -> tuple[float, float]:
        """The least and the greatest change of a residual."""
        ends = np.stack((-step * self.least[1:], -step * self.most[1:]))
        return float(ends.min(0).sum()), float(ends.max(0).sum())

    def _hold(self, beta: np.ndarray) -> None:
        """Rows that steps twice as long as the one to ``beta`` could take past a median."""
        before, middle, away = self.last
        low, high = self._moves(beta - before)
        reach = 2 * (high - low) + 1e-9 * away
        near, far = away - 2 * reach, away + 2 * reach
        u = self.residual(before) - middle
        a = F.abs(u)
        zone = (a <= reach) | ((a >= near) & (a <= far))
        k, below, inside, n = self.rows.agg(F.count_if(zone), F.count_if(u < -reach), F.count_if(a < near), F.count(u)).first()
        self.held = None
        if k * (len(self.x) + 2) <= NEAR:
            m = self.rows.filter(zone).select(u.alias("__u"), self.y.alias("__y"), *[v.alias(f"__{i}") for i, v in enumerate(self.x)]).toArrow()
            self.held = before, middle, reach, near, far, below, inside, n, np.array([c.to_numpy() for c in m.columns])

    def _decided(self, beta: np.ndarray) -> tuple[float, float] | None:
        if not self.held:
            return None
        before, middle, reach, near, far, below, inside, n, (u, y, *x) = self.held
        low, high = self._moves(beta - before)
        slack = 1e-12 * float(np.maximum(np.abs(self.least), np.abs(self.most)) @ np.abs([1.0, *(np.abs(beta) + np.abs(before))]))
        e, a = y - beta @ np.array(x), np.abs(u)

        def between(values: np.ndarray, skipped: int, least: float, most: float) -> float | None:
            i, j = (n - 1) // 2 - skipped, n // 2 - skipped
            if i < 0 or j >= len(values):
                return None
            i, j = np.partition(values, (i, j))[[i, j]]
            return float(0.5 * i + 0.5 * j) if least <= i and j <= most else None

        # rows that aren't held are below the first end or above the second
        now = between(e[a <= reach], below, middle - reach + high + slack, middle + reach + low - slack)
        if now is None:
            return None
        moved = max(abs(low - now + middle), abs(high - now + middle)) + slack
        own = between(np.abs(e - now)[(a >= near) & (a <= far)], inside, near + moved, far - moved)
        return None if own is None else (now, own)


@dataclass
class RobustRegression(LinearModel):
    """Reweighted least squares with the scale from the median absolute deviation."""

    estimator: str = "huber"
    tuning: float | None = None
    fit_intercept: bool = True
    max_iter: int = 50
    tol: float = 1e-6
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, df, columns, target):
        x, p = design(columns, self.fit_intercept), len(columns) + self.fit_intercept
        rows = df.select(clean(target).alias("__y"), *[clean(c).alias(c) for c in columns]).persist()
        try:
            start = LinearRegression(self.fit_intercept).fit(rows, columns, "__y")
            beta = np.array(([start.intercept] if self.fit_intercept else []) + start.coefficients)
            medians = Medians(rows, x, "__y")
            for _ in range(self.max_iter):
                self.scale = max(medians.of(beta)[1] / 0.6745, 1e-12)
                m = product_sums(rows, [*x, F.col("__y")], robust_weight(medians.residual(beta) / self.scale, self.estimator, self.tuning))
                new = solve(m[:p, :p], m[:p, p])
                moved, beta = np.abs(new - beta).max(), new
                if moved < self.tol:
                    break
        finally:
            rows.unpersist()
        return self._set(columns, beta, self.fit_intercept)


@dataclass
class QuantileRegression(LinearModel):
    """The check loss by reweighting each residual with tau or 1 - tau over its size."""

    tau: float = 0.5
    fit_intercept: bool = True
    max_iter: int = 100
    tol: float = 1e-6
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, df, columns, target):
        start = LinearRegression(self.fit_intercept).fit(df, columns, target)
        beta = np.array(([start.intercept] if self.fit_intercept else []) + start.coefficients)
        x, p = design(columns, self.fit_intercept), len(columns) + self.fit_intercept
        rows = df.select(clean(target).alias("__y"), *[clean(c).alias(c) for c in columns]).persist()
        floor = max(math.sqrt(start.sigma2) * 1e-4, 1e-10)
        try:
            for _ in range(self.max_iter):
                e = F.col("__y") - sum((v * float(b) for v, b in zip(x, beta)), F.lit(0.0))
                w = F.when(e >= 0, self.tau).otherwise(1 - self.tau) / F.greatest(F.abs(e), F.lit(floor))
                m = product_sums(rows, [*x, F.col("__y")], w)
                new = solve(m[:p, :p], m[:p, p])
                moved, beta = np.abs(new - beta).max(), new
                if moved < self.tol * max(1.0, np.abs(beta).max()):
                    break
        finally:
            rows.unpersist()
        return self._set(columns, beta, self.fit_intercept)


def _losses(kind: str, f: Column, y: Column, epsilon: float) -> Column:
    """The derivative of a loss by the score; y is +1/-1 for margins."""
    if kind == "hinge":
        return F.when(y * f < 1, -y).otherwise(0.0)
    if kind == "squared_hinge":
        return F.when(y * f < 1, -2 * y * (1 - y * f)).otherwise(0.0)
    if kind == "log":
        return -y * sigmoid(-y * f)
    if kind == "modified_huber":
        return F.when(y * f >= 1, 0.0).when(y * f >= -1, -2 * y * (1 - y * f)).otherwise(-4 * y)
    if kind == "perceptron":
        return F.when(y * f <= 0, -y).otherwise(0.0)
    if kind == "squared":
        return f - y
    if kind == "epsilon_insensitive":
        return F.when(f - y > epsilon, 1.0).when(y - f > epsilon, -1.0).otherwise(0.0)
    if kind == "huber":
        return F.least(F.greatest(f - y, F.lit(-epsilon)), F.lit(epsilon))
    raise InvalidInput(f"no loss {kind}")


@dataclass
class GradientLinear(LinearModel):
    """Linear models by loss (hinge, squared_hinge, log, modified_huber, perceptron, squared, epsilon_insensitive, huber).

    Full-batch accelerated subgradient steps on standardised columns, one aggregate a
    step, so the result doesn't depend on the rows' order. ``partial_fit`` goes on from
    where the model is. Margin losses want 0/1 targets and predict those.
    """

    loss: str = "hinge"
    penalty: str = "l2"
    alpha: float = 1e-4
    l1_ratio: float = 0.15
    epsilon: float = 0.1
    rate: float = 0.5
    max_iter: int = 100
    tol: float = 1e-6
    columns: tuple[str, ...] = ()
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    @property
    def is_classifier(self) -> bool:
        return self.loss in ("hinge", "squared_hinge", "log", "modified_huber", "perceptron")

    def fit(self, df, columns, target):
        self.coefficients, self.intercept = [], 0.0
        return self.partial_fit(df, columns, target)

    def partial_fit(self, df, columns, target):
        self.columns = tuple(columns)
        stats = df.agg(*[f(clean(c)) for c in columns for f in (F.avg, F.stddev_pop)]).first()
        mean, std = np.array(stats[0::2], float), np.array(stats[1::2], float)
        std[std < 1e-10] = 1.0
        y = F.when(F.col(target) > 0.5, 1.0).otherwise(-1.0) if self.is_classifier else clean(target)
        rows = df.select(y.alias("__y"), *[((clean(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(columns, mean, std)]).persist()
        beta = np.zeros(len(columns) + 1)
        if self.coefficients:
            beta[1:] = np.array(self.coefficients) * std
            beta[0] = self.intercept + mean @ np.array(self.coefficients)
        before, x = beta.copy(), [F.lit(1.0), *[F.col(c) for c in columns]]
        try:
            for step in range(self.max_iter):
                look = beta + step / (step + 3) * (beta - before)
                f = sum((v * float(b) for v, b in zip(x, look)), F.lit(0.0))
                g = np.array(rows.agg(*[F.avg(_losses(self.loss, f, F.col("__y"), self.epsilon) * v) for v in x]).first(), float)
                if self.penalty in ("l2", "elasticnet"):
                    g[1:] += self.alpha * (1 - (self.l1_ratio if self.penalty == "elasticnet" else 0)) * look[1:]
                rate = self.rate / (1 + step / 50)
                new = look - rate * g
                l1 = self.alpha * (1.0 if self.penalty == "l1" else self.l1_ratio if self.penalty == "elasticnet" else 0.0)
                new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * l1, 0)
                moved, before, beta = np.abs(new - beta).max(), beta, new
                if moved < self.tol:
                    break
        finally:
            rows.unpersist()
        self.coefficients = (beta[1:] / std).tolist()
        self.intercept = float(beta[0] - (beta[1:] / std) @ mean)
        return self

    def predict(self, df, name="prediction"):
        f = self.expression()
        return df.withColumn(name, F.when(f > 0, 1.0).otherwise(0.0) if self.is_classifier else f)


def Perceptron(**options) -> GradientLinear:
    return GradientLinear(loss="perceptron", penalty="none", **options)


def LinearSVC(c: float = 1.0, loss: str = "squared_hinge", n_rows: int = 1000, **options) -> GradientLinear:
    """The penalty is 1 / (c n)."""
    return GradientLinear(loss=loss, alpha=1 / (c * n_rows), **options)


def LinearSVR(c: float = 1.0, epsilon: float = 0.0, n_rows: int = 1000, **options) -> GradientLinear:
    return GradientLinear(loss="epsilon_insensitive", epsilon=epsilon, alpha=1 / (c * n_rows), **options)


def PassiveAggressive(c: float = 1.0, **options) -> GradientLinear:
    """The hinge loss with steps of at most c."""
    return GradientLinear(loss="hinge", penalty="none", rate=min(c, 1.0), **options)


@dataclass
class IsotonicRegression:
    """The monotone step function of least squares; tied x are pooled first, then neighbours.

    Distinct x with their sums are what goes to the driver.
    """

    increasing: bool = True
    low: float | None = None
    high: float | None = None
    out_of_bounds: str = "clip"

    def fit(self, df: DataFrame, x: str, y: str) -> IsotonicRegression:
        self.x = x
        g = df.groupBy(clean(x).alias("x")).agg(F.sum(clean(y)).alias("s"), F.count(y).alias("n")).filter("x IS NOT NULL").orderBy("x").toArrow()
        sign = 1.0 if self.increasing else -1.0
        blocks: list[list[float]] = []  # sum, weight, first x, last x
        for v, s, n in zip(*(g.column(c).to_pylist() for c in ("x", "s", "n"))):
            blocks.append([sign * s, n, v, v])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s2, n2, _, last = blocks.pop()
                blocks[-1][0] += s2
                blocks[-1][1] += n2
                blocks[-1][3] = last
        self.points: list[tuple[float, float]] = []
        for s, n, a, b in blocks:
            value = sign * s / n
            value = max(value, self.low) if self.low is not None else value
            value = min(value, self.high) if self.high is not None else value
            self.points += [(a, value)] if a == b else [(a, value), (b, value)]
        return self

    def expression(self, x: Column) -> Column:
        (a, ya), (b, yb) = self.points[0], self.points[-1]
        if self.out_of_bounds == "clip":
            below, above = F.lit(ya), F.lit(yb)
        elif self.out_of_bounds == "nan":
            below = above = F.lit(None).cast("double")
        else:
            below = above = F.raise_error(F.lit("x is out of bounds")).cast("double")
        at = F.array(*[F.struct(F.lit(p).alias("x"), F.lit(v).alias("y")) for p, v in self.points])
        left = F.element_at(F.filter(at, lambda p: p["x"] <= x), -1)
        right = F.element_at(F.filter(at, lambda p: p["x"] >= x), 1)
        inside = F.when(right["x"] > left["x"], left["y"] + (right["y"] - left["y"]) * (x - left["x"]) / (right["x"] - left["x"])).otherwise(left["y"])
        return F.when(x.isNull(), F.lit(None).cast("double")).when(x < a, below).when(x > b, above).otherwise(inside)

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.expression(clean(self.x)))


def multi_output(make: Callable, df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> dict[str, object]:
    """A model for each target."""
    return {t: make().fit(df, columns, t) for t in targets}
