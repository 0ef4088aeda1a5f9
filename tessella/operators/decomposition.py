"""Decompositions of product matrices: one aggregate, eigenvectors on the driver, projections as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import clean
from tessella.operators.linear import product_sums


def project(df: DataFrame, columns: Sequence[str], mean: np.ndarray, directions: np.ndarray, prefix: str) -> DataFrame:
    """Columns <prefix>0.. of the rows' coordinates along the directions (one a row)."""
    return df.select("*", *[sum(((clean(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, d)), F.lit(0.0)).alias(f"{prefix}{k}") for k, d in enumerate(directions)])


def unproject(df: DataFrame, columns: Sequence[str], mean: np.ndarray, directions: np.ndarray, prefix: str) -> DataFrame:
    return df.select("*", *[sum((F.col(f"{prefix}{k}") * float(d[j]) for k, d in enumerate(directions)), F.lit(float(mean[j]))).alias(f"{c}_restored") for j, c in enumerate(columns)])


def _signs(vectors: np.ndarray) -> np.ndarray:
    """Directions with their largest coordinate positive."""
    return vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]


@dataclass
class PCA:
    """Principal components; n_components a number or, under 1, a share of variance. Batches may be added."""

    n_components: float | None = None
    whiten: bool = False
    columns: tuple[str, ...] = ()
    products: np.ndarray | None = field(default=None)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> PCA:
        self.products = None
        return self.partial_fit(df, columns)

    def partial_fit(self, df: DataFrame, columns: Sequence[str]) -> PCA:
        self.columns = tuple(columns)
        m = product_sums(df, [F.lit(1.0), *[clean(c) for c in columns]])
        self.products = m if self.products is None else self.products + m
        n, s = self.products[0, 0], self.products[0, 1:]
        if n < 2:
            raise InvalidInput("two rows are needed")
        self.n, self.mean = n, s / n
        values, vectors = np.linalg.eigh((self.products[1:, 1:] - np.outer(s, s) / n) / (n - 1))
        values, vectors = np.maximum(values[::-1], 0), _signs(vectors[:, ::-1].T)
        ratio = values / values.sum() if values.sum() > 0 else values
        k = len(values) if self.n_components is None else int(np.searchsorted(np.cumsum(ratio), self.n_components - 1e-12) + 1) if self.n_components < 1 else int(self.n_components)
        self.components, self.explained_variance, self.explained_ratio = vectors[:k], values[:k], ratio[:k]
        self.singular_values = np.sqrt(values[:k] * (n - 1))
        self.noise_variance = float(values[k:].mean()) if k < len(values) else 0.0
        return self

    def _directions(self):
        return self.components / np.sqrt(np.maximum(self.explained_variance, 1e-20))[:, None] if self.whiten else self.components

    def transform(self, df: DataFrame) -> DataFrame:
        return project(df, self.columns, self.mean, self._directions(), "pc")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        back = self.components * np.sqrt(self.explained_variance)[:, None] if self.whiten else self.components
        return unproject(df, self.columns, self.mean, back, "pc")


@dataclass
class TruncatedSVD:
    """Singular vectors of the uncentred table."""

    n_components: int = 2

    def fit(self, df: DataFrame, columns: Sequence[str]) -> TruncatedSVD:
        self.columns = tuple(columns)
        values, vectors = np.linalg.eigh(product_sums(df, [clean(c) for c in columns]))
        k = min(self.n_components, len(columns))
        self.singular_values, self.components = np.sqrt(np.maximum(values[::-1][:k], 0)), _signs(vectors[:, ::-1].T[:k])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return project(df, self.columns, np.zeros(len(self.columns)), self.components, "sv")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return unproject(df, self.columns, np.zeros(len(self.columns)), self.components, "sv")


def rotate(loadings: np.ndarray, gamma: float = 1.0, steps: int = 200) -> np.ndarray:
    """Orthogonal rotation: varimax (gamma 1) or quartimax (gamma 0)."""
    p, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(steps):
        turned = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (turned**3 - gamma / p * turned * (turned**2).sum(axis=0)))
        turn = u @ v
        if s.sum() - before < 1e-10 * s.sum():
            break
        before = s.sum()
    return loadings @ turn


def promax(loadings: np.ndarray, power: int = 4) -> np.ndarray:
    varied = rotate(loadings)
    target = varied * np.abs(varied) ** (power - 1)
    turn = np.linalg.lstsq(varied, target, rcond=None)[0]
    turn *= np.sqrt(np.diag(np.linalg.pinv(turn.T @ turn)))
    return varied @ turn


@dataclass
class FactorAnalysis:
    """Factors by expectation maximisation on the covariance alone."""

    n_factors: int = 2
    rotation: str | None = None
    max_iter: int = 1000
    tol: float = 1e-8

    def fit(self, df: DataFrame, columns: Sequence[str]) -> FactorAnalysis:
        self.columns = tuple(columns)
        m = product_sums(df, [F.lit(1.0), *[clean(c) for c in columns]])
        n, s = m[0, 0], m[0, 1:]
        self.mean = s / n
        cov = m[1:, 1:] / n - np.outer(self.mean, self.mean)
        noise, k = np.diag(cov).copy(), self.n_factors
        before = -np.inf
        for _ in range(self.max_iter):
            root = np.sqrt(noise) + 1e-12
            values, vectors = np.linalg.eigh(cov / np.outer(root, root))
            top, w = values[::-1][:k], vectors[:, ::-1][:, :k]
            load = root[:, None] * w * np.sqrt(np.maximum(top - 1, 0))
            noise = np.maximum(np.diag(cov) - (load**2).sum(axis=1), 1e-12)
            model = load @ load.T + np.diag(noise)
            like = -n / 2 * (np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, cov)) + len(s) * np.log(2 * np.pi))
            if like - before < self.tol * abs(like):
                break
            before = like
        self.log_likelihood, self.noise = float(like), noise
        turn = {None: lambda x: x, "varimax": rotate, "quartimax": lambda x: rotate(x, 0.0), "promax": promax}[self.rotation]
        self.loadings = turn(load)
        scaled = self.loadings / noise[:, None]
        self.weights = np.linalg.solve(np.eye(k) + self.loadings.T @ scaled, scaled.T)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return project(df, self.columns, self.mean, self.weights, "factor")


def tsne(df: DataFrame, row_id: str, columns: Sequence[str], n_components: int = 2, perplexity: float = 30.0, steps: int = 500, rate: float = 200.0, seed: int = 0, max_rows: int = 5_000) -> DataFrame:
    """Exact t-SNE of at most ``max_rows`` rows, on the driver; more rows are an error."""
    rows = df.select(row_id, *[clean(c).alias(c) for c in columns]).limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise InvalidInput("too many rows for t-SNE")
    x = rows[list(columns)].to_numpy(float)
    n = len(x)
    d = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        own = np.delete(d[i], i)
        for _ in range(60):
            e = np.exp(-(own - own.min()) * beta)
            q = e / e.sum()
            entropy = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(entropy - np.log(min(perplexity, n - 1))) < 1e-5:
                break
            low, high = (beta, high) if entropy > np.log(perplexity) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, move, gain = rng.normal(0, 1e-4, (n, n_components)), np.zeros((n, n_components)), np.ones((n, n_components))
    for step in range(steps):
        w = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1) - 2 * y @ y.T, 0))
        np.fill_diagonal(w, 0)
        f = ((4.0 if step < 100 else 1.0) * p - np.maximum(w / w.sum(), 1e-12)) * w
        g = 4 * (f.sum(1)[:, None] * y - f @ y)
        gain = np.maximum(np.where(np.sign(g) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if step < 250 else 0.8) * move - rate * gain * g
        y = y + move
        y -= y.mean(0)
    out = rows[[row_id]].assign(**{f"tsne{k}": y[:, k] for k in range(n_components)})
    return df.sparkSession.createDataFrame(out)
