"""Model selection: cross-validation scores, searches, samplers, pruners, AutoML.

Trials are few, so they are driver objects; every score is an aggregate over a table.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import clean, stacked
from tessella.functions import specfun as sf
from tessella.operators import metrics as M
from tessella.operators.splits import kfold, stratified_kfold

Scorer = Callable[[DataFrame, str, str], float]


def accuracy(df: DataFrame, y: str, p: str) -> float:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double"))).first()[0]


def r2(df: DataFrame, y: str, p: str) -> float:
    return M.regression_scores(df, y, p).select("r2").first()[0]  # the median of all errors isn't computed


def negative_mse(df: DataFrame, y: str, p: str) -> float:
    return -df.agg(F.avg((clean(y) - clean(p)) ** 2)).first()[0]


@dataclass(frozen=True)
class CVResult:
    """Scores of folds with their mean, deviation and t interval; failed folds are told."""

    scores: tuple[float, ...]
    train_scores: tuple[float, ...] = ()
    failures: tuple[str, ...] = ()

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores)

    @property
    def std(self) -> float:
        m = self.mean
        return math.sqrt(sum((s - m) ** 2 for s in self.scores) / max(len(self.scores) - 1, 1))

    def interval(self, level: float = 0.95) -> tuple[float, float]:
        n = len(self.scores)
        half = sf.t_quantile(0.5 + level / 2, n - 1) * self.std / math.sqrt(n) if n > 1 else math.inf
        return self.mean - half, self.mean + half

    def better_than(self, other: CVResult) -> bool:
        """Whether the intervals don't meet."""
        return self.interval()[0] > other.interval()[1]


def cross_val_score(make: Callable[[], object], df: DataFrame, columns: Sequence[str], target: str, order: Sequence[str], score: Scorer = r2, folds: int = 5, stratified: bool = False, train_scores: bool = False) -> CVResult:
    folded = _folded(df, columns, target, order, folds, stratified).persist()
    try:
        return _fold_scores(make, folded, columns, target, score, folds, train_scores)
    finally:
        folded.unpersist()


def _folded(df: DataFrame, columns: Sequence[str], target: str, order: Sequence[str], folds: int, stratified: bool) -> DataFrame:
    """The columns that models and scores read, with the number of the fold."""
    df = df.select(*dict.fromkeys([*columns, target, *order]))
    return stratified_kfold(df, folds, target, order, "__fold") if stratified else kfold(df, folds, order, "__fold")


def _fold_scores(make: Callable[[], object], folded: DataFrame, columns: Sequence[str], target: str, score: Scorer, folds: int, train_scores: bool) -> CVResult:
    got, trained, failed = [], [], []
    for f in range(folds):
        train, test = folded.filter(F.col("__fold") != f).drop("__fold"), folded.filter(F.col("__fold") == f).drop("__fold")
        try:
            model = make().fit(train, list(columns), target)
            got.append(float(score(model.predict(test), target, "prediction")))
            if train_scores:
                trained.append(float(score(model.predict(train), target, "prediction")))
        except InvalidInput as error:
            failed.append(f"fold {f}: {error}")
    if not got:
        raise InvalidInput(f"every fold failed: {failed}")
    return CVResult(tuple(got), tuple(trained), tuple(failed))


def learning_curve(make, df, columns, target, order, sizes: Sequence[float] = (0.1, 0.33, 0.55, 0.78, 1.0), score: Scorer = r2, folds: int = 5) -> dict[float, CVResult]:
    """Scores after training on the first rows, in hashed order, of each training part."""
    folded = kfold(df, folds, order, "__fold").withColumn("__u", F.pmod(F.xxhash64(*order), F.lit(1 << 30)) / float(1 << 30)).persist()
    found = {}
    for size in sizes:
        got = []
        for f in range(folds):
            model = make().fit(folded.filter((F.col("__fold") != f) & (F.col("__u") < size)), list(columns), target)
            got.append(float(score(model.predict(folded.filter(F.col("__fold") == f)), target, "prediction")))
        found[size] = CVResult(tuple(got))
    folded.unpersist()
    return found


def validation_curve(make: Callable[..., object], df, columns, target, order, name: str, values: Sequence, score: Scorer = r2, folds: int = 5) -> dict:
    """Scores for each value; the folds are dealt once."""
    folded = _folded(df, columns, target, order, folds, False).persist()
    try:
        return {v: _fold_scores(lambda: make(**{name: v}), folded, columns, target, score, folds, True) for v in values}
    finally:
        folded.unpersist()


@dataclass(frozen=True)
class Param:
    """A range (int or float, optionally by its logarithm) or a list of choices."""

    low: float = 0.0
    high: float = 1.0
    kind: str = "float"
    log: bool = False
    choices: tuple = ()

    def at(self, u: float):
        if self.choices:
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return min(int(math.floor(v + 0.5)), int(self.high)) if self.kind == "int" else v

    def unit(self, v) -> float:
        if self.choices:
            return (self.choices.index(v) + 0.5) / len(self.choices)
        if self.log:
            return (math.log(v) - math.log(self.low)) / max(math.log(self.high) - math.log(self.low), 1e-300)
        return (v - self.low) / max(self.high - self.low, 1e-300)

    def grid(self, n: int) -> list:
        return list(self.choices) if self.choices else list(dict.fromkeys(self.at(i / (n - 1) if n > 1 else 0.5) for i in range(n)))


Space = dict[str, Param]


def grid_points(space: Space, n: int = 3) -> Iterator[dict]:
    """All combinations, the last parameter fastest."""
    for values in itertools.product(*[p.grid(n) for p in space.values()]):
        yield dict(zip(space, values))


@dataclass
class Trial:
    params: dict
    value: float | None = None
    state: str = "running"
    intermediate: list[float] = field(default_factory=list)


@dataclass
class RandomSampler:
    seed: int = 0

    def sample(self, study: Study) -> dict:
        rng = random.Random(f"{self.seed}:{len(study.trials)}")
        return {k: p.at(rng.random()) for k, p in study.space.items()}


@dataclass
class GridSampler:
    points: int = 3

    def sample(self, study: Study) -> dict:
        every = list(grid_points(study.space, self.points))
        return every[len(study.trials) % len(every)]


def _finished(study: Study) -> list[Trial]:
    done = [t for t in study.trials if t.value is not None and not math.isnan(t.value)]
    return sorted(done, key=lambda t: t.value, reverse=study.maximize)


@dataclass
class TPESampler:
    """Draws near good trials and picks the candidate whose density among the good is greatest against the rest."""

    startup: int = 10
    gamma: float = 0.25
    candidates: int = 24
    seed: int = 0

    def sample(self, study):
        done = _finished(study)
        if len(done) < self.startup:
            return RandomSampler(self.seed).sample(study)
        rng = random.Random(f"{self.seed}:{len(study.trials)}")
        cut = max(1, math.ceil(self.gamma * len(done)))
        out = {}
        for k, p in study.space.items():
            good, rest = [p.unit(t.params[k]) for t in done[:cut]], [p.unit(t.params[k]) for t in done[cut:]]

            def density(u, at, width):
                return sum(math.exp(-0.5 * ((u - a) / width) ** 2) for a in at) / (len(at) * width) + 1e-3 if at else 1.0

            wg, wr = max(0.05, len(good) ** -0.2 * 0.3), max(0.05, max(len(rest), 1) ** -0.2 * 0.3)
            drawn = [min(max(rng.gauss(rng.choice(good), wg), 0.0), 1.0) for _ in range(self.candidates)]
            out[k] = p.at(max(drawn, key=lambda u: density(u, good, wg) / density(u, rest, wr)))
        return out


@dataclass
class BayesSampler:
    """A Gaussian process on the unit cube; expected improvement, its probability, or an upper bound."""

    startup: int = 5
    acquisition: str = "ei"
    kappa: float = 1.96
    length: float = 0.3
    candidates: int = 512
    seed: int = 0

    def sample(self, study):
        done = _finished(study)
        if len(done) < self.startup:
            return RandomSampler(self.seed).sample(study)
        x = np.array([[p.unit(t.params[k]) for k, p in study.space.items()] for t in done])
        y = np.array([t.value if study.maximize else -t.value for t in done])
        mean, scale = y.mean(), y.std() or 1.0
        z = (y - mean) / scale
        rng = np.random.default_rng([self.seed, len(study.trials)])
        c = rng.random((self.candidates, x.shape[1]))

        def kernel(a, b):
            d = np.sqrt(5 * np.maximum(((a[:, None] - b[None]) ** 2).sum(-1), 0)) / self.length
            return (1 + d + d * d / 3) * np.exp(-d)

        low = np.linalg.cholesky(kernel(x, x) + 1e-6 * np.eye(len(x)))
        alpha = np.linalg.solve(low.T, np.linalg.solve(low, z))
        k = kernel(c, x)
        mu = k @ alpha
        sd = np.sqrt(np.maximum(1 - (np.linalg.solve(low, k.T) ** 2).sum(0), 1e-12))
        gap = mu - z.max()
        u = gap / sd
        cdf = np.array([sf.normal_cdf(v) for v in u])
        value = {"ei": gap * cdf + sd * np.exp(-u * u / 2) / math.sqrt(2 * math.pi), "pi": cdf, "ucb": mu + self.kappa * sd}[self.acquisition]
        best = c[int(value.argmax())]
        return {name: p.at(float(v)) for (name, p), v in zip(study.space.items(), best)}


@dataclass
class Study:
    """Ask for parameters, tell their value; the best ignores missing values."""

    space: Space
    maximize: bool = True
    sampler: object = field(default_factory=RandomSampler)
    trials: list[Trial] = field(default_factory=list)

    def ask(self) -> Trial:
        trial = Trial(self.sampler.sample(self))
        self.trials.append(trial)
        return trial

    def tell(self, trial: Trial, value: float | None, state: str = "complete") -> None:
        trial.value, trial.state = value, state

    @property
    def best(self) -> Trial:
        return _finished(self)[0]

    def optimise(self, objective: Callable[[dict], float], n: int) -> Trial:
        for _ in range(n):
            trial = self.ask()
            self.tell(trial, objective(trial.params))
        return self.best

    def table(self, spark) -> DataFrame:
        rows = [(i, {k: str(v) for k, v in t.params.items()}, t.value, t.state, t.intermediate) for i, t in enumerate(self.trials)]
        return spark.createDataFrame(rows, "trial int, params map<string,string>, value double, state string, intermediate array<double>")

    def importance(self) -> dict[str, float]:
        """Shares of the absolute correlations of parameters with values; ten trials at least."""
        done = _finished(self)
        if len(done) < 10:
            raise InvalidInput("ten finished trials are needed")
        y = np.array([t.value for t in done])
        found = {}
        for k, p in self.space.items():
            x = np.array([p.unit(t.params[k]) for t in done])
            found[k] = abs(float(np.corrcoef(x, y)[0, 1])) if x.std() and y.std() else 0.0
        total = sum(found.values())
        return {k: v / total if total else 0.0 for k, v in found.items()}


def _worse(value: float, bar: float, maximize: bool) -> bool:
    return value < bar if maximize else value > bar


@dataclass
class MedianPruner:
    startup: int = 5
    warmup: int = 0
    percentile: float = 50.0

    def should_prune(self, study: Study, trial: Trial) -> bool:
        step = len(trial.intermediate) - 1
        others = [t.intermediate[step] for t in study.trials if t is not trial and len(t.intermediate) > step]
        if step < self.warmup or len(others) < self.startup:
            return False
        ranked = sorted(others, reverse=study.maximize)
        return _worse(trial.intermediate[step], ranked[round(self.percentile / 100 * (len(ranked) - 1))], study.maximize)


@dataclass
class ASHA:
    """At rungs of growing resource a trial goes on only among the best 1/eta."""

    min_resource: int = 1
    eta: int = 3

    def should_prune(self, study: Study, trial: Trial) -> bool:
        step = len(trial.intermediate)
        rung = self.min_resource
        while rung < step:
            rung *= self.eta
        if rung != step:
            return False
        values = sorted((t.intermediate[step - 1] for t in study.trials if len(t.intermediate) >= step), reverse=study.maximize)
        keep = max(1, len(values) // self.eta)
        return len(values) >= self.eta and _worse(trial.intermediate[step - 1], values[keep - 1], study.maximize)


def hyperband(space: Space, run: Callable[[dict, int], float], max_resource: int, eta: int = 3, maximize: bool = True, sampler: object | None = None, seed: int = 0) -> Study:
    """Brackets of successive halving; with a TPE sampler this is BOHB."""
    study = Study(space, maximize, sampler or RandomSampler(seed))
    most = int(math.log(max_resource, eta) + 1e-9)
    for s in range(most, -1, -1):
        n, r = math.ceil((most + 1) / (s + 1) * eta**s), max_resource * eta**-s
        own = [study.ask() for _ in range(n)]
        for i in range(s + 1):
            for t in own:
                value = run(t.params, max(1, int(r * eta**i)))
                t.intermediate.append(value)
                study.tell(t, value)
            own = sorted(own, key=lambda t: t.value, reverse=maximize)[: max(1, len(own) // eta)]
    return study


def grid_search(make: Callable[..., object], grid: dict[str, Sequence], df, columns, target, order, score: Scorer = r2, folds: int = 5) -> tuple[dict, dict]:
    """The best parameters, and the result of every combination."""
    found = {}
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        found[tuple(params.items())] = cross_val_score(lambda: make(**params), df, columns, target, order, score, folds)
    return dict(max(found, key=lambda k: found[k].mean)), found


def randomized_search(make, space: Space, n: int, df, columns, target, order, score: Scorer = r2, folds: int = 5, seed: int = 0) -> Study:
    study = Study(space, True, RandomSampler(seed))
    study.optimise(lambda params: cross_val_score(lambda: make(**params), df, columns, target, order, score, folds).mean, n)
    return study


def nested_cv(make, grid: dict[str, Sequence], df, columns, target, order, score: Scorer = r2, outer: int = 3, inner: int = 3) -> dict[str, float]:
    """Outer score of the inner search's choice, and its optimism."""
    folded = kfold(df, outer, order, "__outer")
    outer_scores, inner_scores = [], []
    for f in range(outer):
        train, test = folded.filter(F.col("__outer") != f).drop("__outer"), folded.filter(F.col("__outer") == f).drop("__outer")
        params, found = grid_search(make, grid, train, columns, target, order, score, inner)
        inner_scores.append(max(r.mean for r in found.values()))
        outer_scores.append(float(score(make(**params).fit(train, columns, target).predict(test), target, "prediction")))
    a, b = sum(outer_scores) / outer, sum(inner_scores) / outer
    return {"outer": a, "inner": b, "optimism": b - a}


def meta_features(df: DataFrame, columns: Sequence[str], target: str) -> dict[str, float]:
    """Size, balance, entropy, skewness, kurtosis, correlation and missing share, in two jobs."""
    long = stacked(df, columns)
    s = long.groupBy("feature").agg(F.skewness("value").alias("s"), F.kurtosis("value").alias("k"), F.avg(F.col("value").isNull().cast("double")).alias("m"), F.avg((F.col("value") == 0).cast("double")).alias("z"), F.count_distinct("value").alias("u"))
    r = s.agg(*[F.avg(c) for c in "skmz"], F.avg("u")).first()
    # every class counts, however many there are: their sizes are summed where they are
    sizes = df.groupBy(target).count().select(F.col("count").cast("double").alias("c")).agg(F.count("*"), F.sum("c"), F.max("c"), F.min("c"), F.sum(F.col("c") * F.ln("c"))).first()
    classes, n, most, least, spread = sizes[0], int(sizes[1] or 0), sizes[2] or 0.0, sizes[3] or 0.0, sizes[4] or 0.0
    corr = df.agg(*[F.abs(F.corr(clean(c), clean(target))) for c in columns]).first() if dict(df.dtypes)[target] not in ("string",) else [None]
    known = [c for c in corr if c is not None and not math.isnan(c)]
    return {"n": n, "p": len(columns), "n_over_p": n / len(columns), "classes": classes, "majority": most / max(n, 1), "minority": least / max(n, 1), "entropy": math.log(n) - spread / n if n else 0.0, "skewness": r[0] or 0.0, "kurtosis": r[1] or 0.0, "missing": r[2] or 0.0, "sparsity": r[3] or 0.0, "distinct": r[4] or 0.0, "correlation": sum(known) / len(known) if known else 0.0}


def recommend(profile: dict[str, float], task: str) -> list[tuple[str, float, str]]:
    """Five (model, score, reason) by rules on the profile."""
    n, p = profile["n"], profile["p"]
    rules = [
        ("hist_gradient_boosting", 0.9 if n >= 1000 else 0.6, "strong on tables of some size"),
        ("random_forest", 0.8 if n >= 200 else 0.65, "robust with few settings"),
        ("linear", 0.8 if n < 50 * p else 0.6, "few rows for each column favour linear models"),
        ("ridge" if task == "regression" else "logistic", 0.75 if p > 20 else 0.7, "shrinkage helps with many columns"),
        ("gaussian_nb" if task == "classification" else "lasso", 0.6 if profile.get("correlation", 0) < 0.3 else 0.5, "cheap baseline"),
        ("knn", 0.6 if n < 10_000 and p < 20 else 0.3, "local structure in few dimensions"),
        ("multinomial_nb" if task == "classification" else "elastic_net", 0.7 if profile.get("sparsity", 0) > 0.5 else 0.4, "made for sparse columns"),
    ]
    return sorted(rules, key=lambda r: -r[1])[:5]


@dataclass
class Bandit:
    """Which arm gets the next trial: ucb1, thompson, epsilon or halving."""

    arms: Sequence[str]
    policy: str = "ucb1"
    epsilon: float = 0.1
    seed: int = 0
    values: dict[str, list[float]] = field(default_factory=dict)

    def select(self) -> str:
        untried = [a for a in self.arms if a not in self.values]
        if untried:
            return untried[0]
        total = sum(map(len, self.values.values()))
        rng = random.Random(f"{self.seed}:{total}")
        mean = {a: sum(v) / len(v) for a, v in self.values.items()}
        if self.policy == "epsilon":
            return rng.choice(list(self.arms)) if rng.random() < self.epsilon else max(mean, key=mean.get)
        if self.policy == "thompson":
            return max(mean, key=lambda a: rng.gauss(mean[a], 1 / math.sqrt(len(self.values[a]))))
        if self.policy == "halving":
            alive = sorted(mean, key=mean.get, reverse=True)[: max(1, math.ceil(len(self.arms) / 2 ** int(math.log2(1 + total / len(self.arms)))))]
            return min(alive, key=lambda a: len(self.values[a]))
        return max(mean, key=lambda a: mean[a] + math.sqrt(2 * math.log(total) / len(self.values[a])))

    def update(self, arm: str, value: float) -> None:
        self.values.setdefault(arm, []).append(value)


@dataclass
class AutoML:
    """Trials over a portfolio until the time or the number is up, then a leaderboard.

    ``portfolio`` maps names to (maker, space). The best models' differences from the
    winner are tested by the corrected resampled t with Holm's correction.
    """

    portfolio: dict[str, tuple[Callable[..., object], Space]]
    task: str = "regression"
    max_trials: int = 20
    seconds: float = 300.0
    folds: int = 3
    policy: str = "ucb1"
    seed: int = 0

    def fit(self, df: DataFrame, columns: Sequence[str], target: str, order: Sequence[str]) -> AutoML:
        score = r2 if self.task == "regression" else accuracy
        bandit = Bandit(list(self.portfolio), self.policy, seed=self.seed)
        studies = {k: Study(s, True, TPESampler(startup=5, seed=self.seed)) for k, (_, s) in self.portfolio.items()}
        end, self.results = time.monotonic() + self.seconds, []
        while len(self.results) < self.max_trials and (time.monotonic() < end or not self.results):
            arm = bandit.select()
            trial = studies[arm].ask()
            make = self.portfolio[arm][0]
            try:
                result = cross_val_score(lambda: make(**trial.params), df, columns, target, order, score, self.folds, self.task == "classification")
            except InvalidInput:
                studies[arm].tell(trial, None, "failed")
                bandit.update(arm, -1.0)
                continue
            studies[arm].tell(trial, result.mean)
            bandit.update(arm, result.mean)
            self.results.append((arm, trial.params, result))
        self.results.sort(key=lambda r: -r[2].mean)
        if not self.results:
            raise InvalidInput("every trial failed")
        name, params, _ = self.results[0]
        self.model = self.portfolio[name][0](**params).fit(df, list(columns), target)
        return self

    def leaderboard(self) -> list[dict]:
        best = self.results[0][2].scores
        rows, tests = [], []
        for i, (name, params, r) in enumerate(self.results):
            p = None
            if i and len(r.scores) == len(best):
                d = [a - b for a, b in zip(best, r.scores)]
                m, v = sum(d) / len(d), np.var(d, ddof=1)
                t = m / math.sqrt((1 / len(d) + 1 / (self.folds - 1)) * v) if v else 0.0
                p = sf.t_two_sided(t, len(d) - 1)
                tests.append((p, i))
            rows.append({"rank": i + 1, "model": name, "params": params, "mean": r.mean, "std": r.std, "p_value": p})
        high = 0.0
        for k, (p, i) in enumerate(sorted(tests)):
            high = max(high, min(1.0, p * (len(tests) - k)))
            rows[i]["adjusted"] = high
        return rows

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df)


def warm_start(history: Sequence[tuple[dict[str, float], dict]], profile: dict[str, float], k: int = 3) -> list[dict]:
    """Parameters that did best on the tables most like this one; history pairs profiles with parameters."""
    def gap(other):
        return sum((math.log1p(abs(other.get(n, 0.0))) - math.log1p(abs(v))) ** 2 for n, v in profile.items())

    return [params for _, params in sorted(history, key=lambda h: gap(h[0]))[:k]]


def preprocessing_steps(profile: dict[str, float], schema_kinds: Sequence[str]) -> list[str]:
    """Transformers that the profile calls for, in order."""
    steps = ["simple_imputer"] if profile.get("missing", 0) > 0 else []
    if "categorical" in schema_kinds:
        steps.append("one_hot_encoder")
    if abs(profile.get("skewness", 0)) > 2:
        steps.append("power_transformer")
    steps.append("max_abs_scaler" if profile.get("sparsity", 0) > 0.5 else "robust_scaler" if profile.get("kurtosis", 0) > 10 else "standard_scaler")
    if profile["p"] > 100:
        steps.append("select_k_best")
    return steps
