"""Descriptive statistics, tests, effect sizes, corrections: aggregates, then closed forms on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import clean, in_order, with_previous
from tessella.functions import specfun as sf


def adjusted_skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when((n < 3) | (F.stddev_samp(x) == 0), 0.0).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when((n < 4) | (F.stddev_samp(x) == 0), 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def descriptive(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, std, sem, min, max, median, q1, q3, iqr, adjusted skewness and kurtosis."""
    x = clean(column)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"), F.min(x).alias("min"), F.max(x).alias("max"),
        q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), adjusted_skewness(x).alias("skewness"), adjusted_kurtosis(x).alias("kurtosis"),
    )


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and r, 0 where a variance is 0."""
    return df.agg(F.count_if(clean(x).isNotNull() & clean(y).isNotNull()).alias("n"), F.coalesce(F.corr(clean(x), clean(y)), F.lit(0.0)).alias("r"))


@dataclass(frozen=True)
class Test:
    """A statistic with its degrees of freedom, p-value and, where there is one, an interval and effect."""

    __test__ = False
    statistic: float
    p_value: float
    df: float | None = None
    interval: tuple[float, float] | None = None
    effect: float | None = None


def correlation(df: DataFrame, x: str, y: str, confidence: float = 0.95) -> Test:
    n, r = pearson(df, x, y).first()
    if abs(r) >= 1 - 1e-15:
        return Test(math.copysign(math.inf, r), 0.0, n - 2, (r, r), r)
    t = r * math.sqrt((n - 2) / (1 - r * r))
    z, half = math.atanh(r), sf.normal_quantile(0.5 + confidence / 2) / math.sqrt(n - 3)
    return Test(t, sf.t_two_sided(t, n - 2), n - 2, (math.tanh(z - half), math.tanh(z + half)), r)


def two_groups(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row of moments of two groups: n1, m1, v1, n2, m2, v2."""
    x, g = clean(value), F.col(group)
    found = []
    for i, level in ((1, a), (2, b)):
        own = F.when(g == F.lit(level), x)
        found += [F.count(own).alias(f"n{i}"), F.avg(own).alias(f"m{i}"), F.var_samp(own).alias(f"v{i}")]
    return df.filter(g.isin(a, b)).agg(*found)


def effect_sizes(moments: DataFrame) -> DataFrame:
    """Cohen's d, Hedges' g and Glass's delta (the second group is the control), with t statistics."""
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    df = (n1 + n2 - 2).cast("double")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / df
    d = (m1 - m2) / F.sqrt(pooled)
    se2 = v1 / n1 + v2 / n2
    welch_df = se2**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    return moments.select(
        d.alias("cohens_d"), (d * (1 - 3 / (4 * df - 1))).alias("hedges_g"), ((m1 - m2) / F.sqrt(v2)).alias("glass_delta"),
        ((m1 - m2) / F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t_pooled"), df.alias("df_pooled"), ((m1 - m2) / F.sqrt(se2)).alias("t_welch"), welch_df.alias("df_welch"),
    )


def t_test(df: DataFrame, value: str, group: str, a, b, equal_variance: bool = False) -> Test:
    moments = two_groups(df, value, group, a, b)
    m, e = moments.first(), effect_sizes(moments).first()
    t, k = (e["t_pooled"], e["df_pooled"]) if equal_variance else (e["t_welch"], e["df_welch"])
    half = 1.96 * math.sqrt(m["v1"] / m["n1"] + m["v2"] / m["n2"])
    return Test(t, sf.t_two_sided(t, k), k, (m["m1"] - m["m2"] - half, m["m1"] - m["m2"] + half), e["cohens_d"])


def average_ranks(df: DataFrame, value: Column, name: str = "rank") -> DataFrame:
    """Ranks with ties averaged, from counts of distinct values: no window holds rows."""
    g = df.groupBy(value.alias("__x")).agg(F.count("*").alias("__n"))
    ranked = in_order(g, ["__x"], sums={"__c": F.col("__n")}).select("__x", (F.col("__c") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranked, value.eqNullSafe(F.col("__x"))).drop("__x")


def mann_whitney_u(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row: u (the smaller), z without corrections, n1, n2."""
    rows = df.filter(F.col(group).isin(a, b) & clean(value).isNotNull()).select(F.col(group).alias("g"), clean(value).alias("x"))
    ranked = average_ranks(rows, F.col("x"))
    s = ranked.agg(F.sum(F.when(F.col("g") == F.lit(a), F.col("rank"))).alias("r1"), F.count_if(F.col("g") == F.lit(a)).alias("n1"), F.count_if(F.col("g") == F.lit(b)).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    return s.select(u.alias("u"), ((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"), "n1", "n2")


def mann_whitney_test(df: DataFrame, value: str, group: str, a, b) -> Test:
    r = mann_whitney_u(df, value, group, a, b).first()
    return Test(r["u"], sf.normal_two_sided(r["z"]))


def normality(df: DataFrame, column: str) -> Test:
    """A skewness and kurtosis statistic against chi-square with two degrees of freedom; effect is 1 / (1 + it)."""
    x = clean(column)
    n, g1, g2 = df.agg(F.count(x), F.skewness(x), F.kurtosis(x)).first()
    k2 = n / 6 * (g1 * g1 + g2 * g2 / 4)
    return Test(k2, sf.chi2_upper(k2, 2), 2, None, 1 / (1 + k2))


def durbin_watson(df: DataFrame, residual: str, order: Sequence[str]) -> DataFrame:
    e = F.col(residual).cast("double")
    rows = with_previous(df.select(e.alias("e"), *order), order, "e", "b")
    return rows.withColumn("d", F.col("e") - F.col("b")).agg((F.sum(F.col("d") ** 2) / F.sum(F.col("e") ** 2)).alias("durbin_watson"))


def iqr_outliers(df: DataFrame, column: str, order: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by k ranges; quartiles are the order statistics at n/4 and 3n/4, truncated."""
    x = clean(column)
    g = df.filter(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    upto = in_order(g, ["v"], sums={"c": F.col("n")}).join(F.broadcast(total), F.lit(True))  # one row
    q = upto.agg(F.min(F.when(F.col("c") > F.floor(F.col("t") / 4), F.col("v"))).alias("q1"), F.min(F.when(F.col("c") > F.floor(3 * F.col("t") / 4), F.col("v"))).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    out = df.join(F.broadcast(q), (x < F.col("q1") - k * spread) | (x > F.col("q3") + k * spread))  # one row of quartiles
    return out.drop("q1", "q3")


def goldfeld_quandt(df: DataFrame, residual: str, order: Sequence[str]) -> DataFrame:
    """One row: the ratio of the later half's mean square to the earlier's."""
    e = F.col(residual).cast("double")
    rows = in_order(df.select(e.alias("e"), *order), order)
    late = F.col("__i") >= df.count() // 2
    return rows.agg((F.avg(F.when(late, F.col("e") ** 2)) / F.avg(F.when(~late, F.col("e") ** 2))).alias("ratio"), F.count_if(late).alias("n_late"), F.count_if(~late).alias("n_early"))


def diagnose_residuals(df: DataFrame, residual: str, order: Sequence[str]) -> dict[str, float]:
    r = goldfeld_quandt(df, residual, order).first()
    return {"normality_p": normality(df, residual).p_value, "durbin_watson": durbin_watson(df, residual, order).first()[0], "goldfeld_quandt": r["ratio"], "goldfeld_quandt_p": sf.f_upper(r["ratio"], r["n_late"], r["n_early"]), "n_outliers": iqr_outliers(df, residual, order).count()}


def paired_t(df: DataFrame, a: str, b: str) -> Test:
    d = clean(a) - clean(b)
    n, m, s = df.agg(F.count(d), F.avg(d), F.stddev_samp(d)).first()
    if not s:
        return Test(0.0 if not m else math.copysign(math.inf, m), 1.0 if not m else 0.0, n - 1, (m, m))
    se = s / math.sqrt(n)
    half = sf.t_quantile(0.975, n - 1) * se
    return Test(m / se, sf.t_two_sided(m / se, n - 1), n - 1, (m - half, m + half))


def corrected_resampled_t(df: DataFrame, a: str, b: str, n_train: int, n_test: int) -> Test:
    """The paired test with the variance enlarged for overlapping training sets."""
    d = clean(a) - clean(b)
    k, m, v = df.agg(F.count(d), F.avg(d), F.var_samp(d)).first()
    if not v:
        return Test(0.0, 1.0, k - 1)
    t = m / math.sqrt((1 / k + n_test / n_train) * v)
    return Test(t, sf.t_two_sided(t, k - 1), k - 1)


def mcnemar(df: DataFrame, y: str, p1: str, p2: str) -> DataFrame:
    """One row: the discordant counts and the continuity-corrected statistic."""
    first, second = F.col(y) == F.col(p1), F.col(y) == F.col(p2)
    b, c = F.count_if(first & ~second), F.count_if(~first & second)
    return df.agg(b.alias("b"), c.alias("c"), F.coalesce(F.try_divide(F.greatest(F.abs(b - c) - 1, F.lit(0)) ** 2, (b + c).cast("double")), F.lit(0.0)).alias("statistic"))


def mcnemar_test(df: DataFrame, y: str, p1: str, p2: str) -> Test:
    s = mcnemar(df, y, p1, p2).first()["statistic"]
    return Test(s, sf.chi2_upper(s, 1), 1)


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, w_plus and the tie-corrected z of the signed ranks, with a continuity term."""
    d = df.select((clean(a) - clean(b)).alias("d")).filter(F.abs("d") > 1e-15)
    g = d.groupBy(F.abs("d").alias("x")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("p"))
    r = in_order(g, ["x"], sums={"c": F.col("t")}).withColumn("rank", F.col("c") - (F.col("t") - 1) / 2)
    s = r.agg(F.sum("t").cast("double").alias("n"), F.sum(F.col("p") * F.col("rank")).alias("w_plus"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n")
    z = F.try_divide(F.abs(F.col("w_plus") - n * (n + 1) / 4) - 0.5, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return s.select("n", "w_plus", z.alias("z"))


def wilcoxon_test(df: DataFrame, a: str, b: str) -> Test:
    z = wilcoxon(df, a, b).first()["z"]
    return Test(z, min(1.0, sf.normal_two_sided(z)))


def five_by_two_t(differences: Sequence[tuple[float, float]]) -> Test:
    if len(differences) != 5:
        raise InvalidInput("five pairs of differences are needed")
    s = sum((a - (a + b) / 2) ** 2 + (b - (a + b) / 2) ** 2 for a, b in differences)
    t = differences[0][0] / math.sqrt(s / 5) if s else 0.0
    return Test(t, sf.t_two_sided(t, 5), 5)


def confidence_interval(df: DataFrame, column: str, level: float = 0.95, method: str = "t") -> tuple[float, float]:
    n, m, s = df.agg(F.count(clean(column)), F.avg(clean(column)), F.stddev_samp(clean(column))).first()
    if method not in ("t", "normal"):
        raise InvalidInput(f"no interval {method}")
    q = sf.t_quantile(0.5 + level / 2, n - 1) if method == "t" else sf.normal_quantile(0.5 + level / 2)
    return m - q * s / math.sqrt(n), m + q * s / math.sqrt(n)


def bootstrap_means(df: DataFrame, column: str, row_id: str, n: int = 1000, seed: int = 0, statistic: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(replicate, value): Poisson bootstrap with hashed weights, the mean unless told otherwise.

    ``statistic`` gets the value and the weight columns and returns an aggregate.
    """
    u = (F.pmod(F.xxhash64(row_id, "replicate", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight = F.lit(7)
    for k in range(6, -1, -1):
        weight = F.when(u < sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), k).otherwise(weight)
    drawn = df.select(row_id, clean(column).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate")).withColumn("w", weight)
    made = statistic(F.col("x"), F.col("w")) if statistic else F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w"))
    return drawn.groupBy("replicate").agg(made.alias("value"))


def bootstrap_interval(df: DataFrame, column: str, row_id: str, n: int = 1000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Standard error and percentile interval of the mean."""
    values = sorted(r["value"] for r in bootstrap_means(df, column, row_id, n, seed).collect() if r["value"] is not None)
    m = sum(values) / len(values)
    se = math.sqrt(sum((v - m) ** 2 for v in values) / (len(values) - 1))
    cut = (1 - confidence) / 2
    return se, values[round(cut * (len(values) - 1))], values[round((1 - cut) * (len(values) - 1))]


def adjust_p_values(df: DataFrame, p: str, method: str, order: str) -> DataFrame:
    """Column ``adjusted``: none, bonferroni, holm, hochberg, bh or by; ties by ``order``."""
    every = Window.partitionBy()
    n, up = F.count("*").over(every), Window.orderBy(F.col(p), F.col(order))
    down = Window.orderBy(F.desc(p), F.desc(order))
    rank, value = F.row_number().over(up), F.col(p)
    if method == "none":
        return df.withColumn("adjusted", value)
    if method == "bonferroni":
        return df.withColumn("adjusted", F.least(value * n, F.lit(1.0)))
    ranked = df.withColumn("__n", n).withColumn("__i", rank)
    if method == "holm":
        made = F.max(value * (F.col("__n") - F.col("__i") + 1)).over(up)
    elif method == "hochberg":
        made = F.min(value * (F.col("__n") - F.col("__i") + 1)).over(down)
    elif method in ("bh", "by"):
        scale = F.aggregate(F.sequence(F.lit(1), F.col("__n").cast("int")), F.lit(0.0), lambda a, i: a + 1 / i) if method == "by" else F.lit(1.0)
        ranked = ranked.withColumn("__q", value * F.col("__n") * scale / F.col("__i"))
        made = F.min("__q").over(down)
    else:
        raise InvalidInput(f"no correction {method}")
    return ranked.withColumn("adjusted", F.least(made, F.lit(1.0))).drop("__n", "__i", "__q")


def count_rejections(df: DataFrame, adjusted: str = "adjusted", alpha: float = 0.05) -> DataFrame:
    """One row: rejections (strictly under alpha) and the false discoveries expected among them."""
    k = F.count_if(F.col(adjusted) < alpha)
    return df.agg(k.alias("rejections"), (k * alpha).alias("expected_false"))


def sample_size(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows a group for a two-sided two-sample comparison."""
    z = sf.normal_quantile(1 - alpha / 2) + sf.normal_quantile(power)
    return math.ceil(2 * (z / effect) ** 2)


def achieved_power(n: int, effect: float, alpha: float = 0.05) -> float:
    return sf.normal_cdf(abs(effect) * math.sqrt(n / 2) - sf.normal_quantile(1 - alpha / 2))


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: eta squared and omega squared of a grouping."""
    g = df.groupBy(group).agg(F.count(clean(value)).alias("n"), F.avg(clean(value)).alias("m"), F.var_pop(clean(value)).alias("v"))
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"), F.sum(F.col("n") * F.col("m")).alias("t"))
    between = F.col("q") - F.col("t") ** 2 / F.col("n")
    ms = F.col("w") / (F.col("n") - F.col("k"))
    return s.select((between / (between + F.col("w"))).alias("eta_squared"), ((between - (F.col("k") - 1) * ms) / (between + F.col("w") + ms)).alias("omega_squared"))
