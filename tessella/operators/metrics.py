"""Metrics of predictions and clusterings, each from one grouped pass."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import in_order, with_previous
from tessella.operators.pairs import ends_by_label, reduce_pairs, sums_by_label


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows (truth, prediction, n) on the full grid of labels."""
    counts = df.groupBy(F.col(y).cast("long").alias("truth"), F.col(p).cast("long").alias("prediction")).agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("truth", "prediction")).alias("label")).distinct()
    # labels, not rows, are paired
    grid = labels.select(F.col("label").alias("truth")).join(labels.select(F.col("label").alias("prediction")), F.lit(True))
    return grid.join(counts, ["truth", "prediction"], "left").fillna(0, ["n"])


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per label: precision, recall, f1, support; 0/0 is 0."""
    c = df.groupBy(F.col(y).cast("long").alias("truth"), F.col(p).cast("long").alias("prediction")).agg(F.count("*").alias("n"))
    both = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
    )
    per = c.select(F.explode(both).alias("s")).select("s.*").groupBy("label").agg(*[F.sum(k).alias(k) for k in ("support", "predicted", "hit")])
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return per.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "predicted", "hit")


def classification_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: accuracy, macro, micro and weighted scores, balanced accuracy, MCC, kappa."""
    r = classification_report(df, y, p)
    n, hit = F.sum("support"), F.sum("hit")
    expected = F.sum(F.col("support").cast("double") * F.col("predicted"))
    found = [n.alias("n"), (hit / n).alias("accuracy")]
    for k in ("precision", "recall", "f1"):
        found += [F.avg(k).alias(f"{k}_macro"), (F.sum(F.col(k) * F.col("support")) / n).alias(f"{k}_weighted")]
    found += [(hit / n).alias("f1_micro"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy")]
    truth, guess = F.sum(F.col("support").cast("double") ** 2), F.sum(F.col("predicted").cast("double") ** 2)
    spread = (n * n - truth) * (n * n - guess)
    found.append(F.when(spread > 0, (hit * n - expected) / F.sqrt(spread)).otherwise(0.0).alias("mcc"))
    chance = expected / n / n
    found.append(F.when(F.abs(1 - chance) < 1e-15, F.when(hit == n, 1.0).otherwise(0.0)).otherwise((hit / n - chance) / (1 - chance)).alias("kappa"))
    return r.agg(*found)


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tp, fp, positives, negatives) by falling score, ties together."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(y) > 0.5).alias("p"), F.count_if(F.col(y) <= 0.5).alias("q"))
    totals = g.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    running = in_order(g, [F.desc("threshold")], sums={"tp": F.col("p"), "fp": F.col("q")})
    return running.join(F.broadcast(totals), F.lit(True)).select("threshold", "tp", "fp", "positives", "negatives", "p", "q")  # one row of totals


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: the area by trapezoids; null if a class is missing."""
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2))
    return roc_points(df, y, score).agg(F.try_divide(area, F.max("positives") * F.max("negatives")).alias("roc_auc"))


def pr_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    points = roc_points(df, y, score)
    return points.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.max("tp").over(Window.partitionBy())).alias("recall"))


def pr_auc(df: DataFrame, y: str, score: str, order: str) -> DataFrame:
    """One row: area and average precision under the envelope; a point a row, ties by ``order``."""
    rows = df.select(F.col(score).alias("s"), F.col(order).alias("o"), (F.col(y) > 0.5).cast("long").alias("hit"))
    ranked = in_order(rows, [F.desc("s"), "o"], sums={"tp": F.col("hit")}).withColumn("k", F.col("__i") + 1).drop("__i")
    enveloped = in_order(ranked, [F.desc("k")], tops={"precision": F.col("tp") / F.col("k")})
    total = rows.agg(F.sum("hit").alias("positives"))
    # the point before follows from the row itself
    before = F.when(F.col("k") > 1, F.greatest("precision", F.try_divide(F.col("tp") - F.col("hit"), F.col("k") - 1))).otherwise(1.0)
    step = F.col("hit") / F.col("positives")
    points = enveloped.join(F.broadcast(total), F.lit(True))  # one row
    return points.agg(F.sum(step * (F.col("precision") + before) / 2).alias("pr_auc"), F.sum(step * F.col("precision")).alias("average_precision"))


def probability_scores(df: DataFrame, y: str, prob: str, eps: float = 1e-15) -> DataFrame:
    """One row: log loss, Brier score and its skill against the base rate."""
    t, p = F.col(y).cast("double"), F.col(prob).cast("double")
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    brier, base = F.avg((p - t) ** 2), F.avg(t) * (1 - F.avg(t))
    return df.agg(F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("log_loss"), brier.alias("brier"), F.when(base > 0, 1 - brier / base).otherwise(1.0).alias("brier_skill"))


def regression_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: mse, rmse, mae, r2, explained variance, greatest and median absolute error, mape."""
    t, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(p).cast("double")
    res, tot = F.sum(e * e), F.var_pop(t) * F.count(t)
    r2 = F.when(F.var_pop(t) == 0, F.when(res == 0, 1.0).otherwise(0.0)).otherwise(1 - res / tot)
    ev = F.when(F.var_pop(t) == 0, F.when(F.var_pop(e) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.var_pop(e) / F.var_pop(t))
    mape = F.when(F.count_if(t == 0) > 0, F.lit(None).cast("double")).otherwise(F.avg(F.abs(F.try_divide(e, t))))
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), ev.alias("explained_variance"), F.max(F.abs(e)).alias("max_error"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_absolute_error"), mape.alias("mape"))


def forecast_scores(df: DataFrame, y: str, p: str, order: Sequence[str]) -> DataFrame:
    """One row: sMAPE in percent and MASE against the row before."""
    t, f = F.col(y).cast("double"), F.col(p).cast("double")
    rows = with_previous(df.select(t.alias("t"), f.alias("f"), *[c for c in order]), order, "t", "b").withColumn("n", F.abs(F.col("t") - F.col("b")))
    smape = 100 * F.avg(F.coalesce(F.try_divide(2 * F.abs(F.col("t") - F.col("f")), F.abs("t") + F.abs("f")), F.lit(0.0)))
    return rows.agg(smape.alias("smape"), F.try_divide(F.avg(F.abs(F.col("t") - F.col("f"))), F.avg("n")).alias("mase"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def clustering_agreement(df: DataFrame, truth: str, labels: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean)."""
    c = contingency(df, truth, labels)
    x = F.col("n").cast("double")
    a = c.groupBy("a").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("sa"), F.sum(F.col("n") * F.ln("n")).alias("la"), F.count("*").alias("ka"))
    b = c.groupBy("b").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("sb"), F.sum(F.col("n") * F.ln("n")).alias("lb"), F.count("*").alias("kb"))
    both = c.agg(F.sum(x * (x - 1) / 2).alias("s"), F.sum(x * F.ln("n")).alias("l"), F.sum(x).alias("t"))
    one = both.join(a, F.lit(True)).join(b, F.lit(True))  # three single rows
    t = F.col("t")
    expected = F.col("sa") * F.col("sb") / (t * (t - 1) / 2)
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.abs(most - expected) < 1e-15, 1.0).otherwise((F.col("s") - expected) / (most - expected))
    ha, hb = F.ln(t) - F.col("la") / t, F.ln(t) - F.col("lb") / t
    mi = F.ln(t) + F.col("l") / t - F.col("la") / t - F.col("lb") / t
    nmi = F.when(ha + hb < 1e-15, 1.0).otherwise(mi / ((ha + hb) / 2))
    return one.select(ari.alias("ari"), nmi.alias("nmi"))


def _array_distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def silhouette_samples(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """(row_id, label, silhouette) by euclidean distance to every row; noise (-1) scores 0, a singleton has a = 0.

    Needs all pairs of rows, in blocks; only their sums by row and label are kept.
    """
    left = df.select(F.col(row_id).alias("i"), F.col(label).alias("k"))
    rows = df.filter(F.col(label) != -1)
    sums = reduce_pairs(rows, rows, sums_by_label(), "i long, k long, l long, s double, n long", row_id, vector, label)
    means = sums.groupBy("i", "k", "l").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("k") == F.col("l")
    per = means.groupBy("i", "k").agg(F.max(F.when(own, F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(0.0))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    value = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    scored = per.select("i", value.alias("s"))
    return left.select("i", "k").join(scored, "i", "left").select(F.col("i").alias(row_id), F.col("k").alias(label), F.coalesce("s", F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    return silhouette_samples(df, row_id, vector, label).agg(F.avg("silhouette").alias("silhouette"))


def cluster_separation(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """One row: Calinski-Harabasz, Davies-Bouldin, within and between sums of squares.

    The overall centroid includes noise rows; clusters are those other than -1.
    """
    flat = df.select(F.col(row_id).alias("i"), F.col(label).alias("k"), F.posexplode(vector).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    overall = flat.groupBy("d").agg(F.avg("x").alias("m"))
    centre = flat.filter("k <> -1").groupBy("k", "d").agg(F.avg("x").alias("c"), F.count("*").alias("n"), F.sum(F.col("x") ** 2).alias("q"))
    centre = centre.withColumn("w", F.col("q") - F.col("n") * F.col("c") ** 2)
    between = centre.join(overall, "d").agg(F.sum(F.col("n") * (F.col("c") - F.col("m")) ** 2).alias("between_ss"), F.sum("w").alias("within_ss"), F.count_distinct("k").alias("g"))
    n = df.filter(F.col(label) != -1).agg(F.count("*").alias("n"))
    distance = flat.filter("k <> -1").join(centre.select("k", "d", "c"), ["k", "d"]).groupBy("k", "i").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("r"))
    scatter = distance.groupBy("k").agg(F.avg("r").alias("s"))
    c2 = centre.select(F.col("k").alias("l"), "d", F.col("c").alias("e"))
    gap = centre.join(c2, "d").filter("k <> l").groupBy("k", "l").agg(F.sqrt(F.sum((F.col("c") - F.col("e")) ** 2)).alias("g")).filter("g > 0")
    ratio = gap.join(scatter, "k").join(scatter.select(F.col("k").alias("l"), F.col("s").alias("t")), "l").groupBy("k").agg(F.max((F.col("s") + F.col("t")) / F.col("g")).alias("r"))
    db = ratio.agg(F.avg("r").alias("davies_bouldin"))
    one = between.join(n, F.lit(True)).join(db, F.lit(True))  # single rows
    ch = F.try_divide(F.col("between_ss") / (F.col("g") - 1), F.col("within_ss") / (F.col("n") - F.col("g")))
    return one.select(ch.alias("calinski_harabasz"), "davies_bouldin", "within_ss", "between_ss")


def dunn_index(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """One row: least distance between clusters over the greatest within one."""
    rows = df.filter(F.col(label) != -1)
    ends = reduce_pairs(rows, rows, ends_by_label(), "least double, most double", row_id, vector, label)
    least, most = F.min(F.when(F.col("least") < float("inf"), F.col("least"))), F.max(F.when(F.col("most") >= 0, F.col("most")))
    return ends.agg(F.try_divide(least, most).alias("dunn"))


def calibration_curve(df: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """(bin, mean_predicted, fraction_positive, n) of equal-width bins; empty bins have zeros."""
    b = F.floor(F.least(F.greatest(F.col(prob).cast("double"), F.lit(0.0)), F.lit(1 - 1e-10)) * bins).cast("int")
    found = df.groupBy(b.alias("bin")).agg(F.avg(prob).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"), F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").fillna(0.0, ["mean_predicted", "fraction_positive"]).fillna(0, ["n"])


def bootstrap_auc(df: DataFrame, y: str, score: str, row_id: str, n: int = 200, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """AUC with a percentile interval: Poisson weights from hashes, all replicates in one plan."""
    u = (F.pmod(F.xxhash64(row_id, "b", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cumulative, weight = 0.0, F.lit(6)
    for k in range(5, -1, -1):
        cumulative = sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))
        weight = F.when(u < cumulative, k).otherwise(weight)
    drawn = df.select(row_id, F.col(y).alias("y"), F.col(score).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("b"))
    drawn = drawn.withColumn("w", F.when(F.col("b") == 0, 1).otherwise(weight))
    g = drawn.groupBy("b", "s").agg(F.sum(F.when(F.col("y") > 0.5, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") > 0.5, 0).otherwise(F.col("w"))).alias("q"))
    tp = F.sum("p").over(Window.partitionBy("b").orderBy(F.desc("s")))
    found = g.withColumn("tp", tp).groupBy("b").agg(F.try_divide(F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)), F.sum("p") * F.sum("q")).alias("auc")).collect()
    by = {r["b"]: r["auc"] for r in found}
    if by.get(0) is None:
        raise InvalidInput("both classes are needed")
    drawn_auc = sorted(v for b, v in by.items() if b and v is not None)
    cut = (1 - confidence) / 2
    return by[0], drawn_auc[round(cut * (len(drawn_auc) - 1))], drawn_auc[round((1 - cut) * (len(drawn_auc) - 1))]


def hopkins(df: DataFrame, row_id: str, vector: str, sample: int = 50, seed: int = 0) -> float:
    """Hopkins statistic: near 0.5 for uniform rows, near 1 for clustered ones."""
    import random

    dims = df.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("d").collect()
    rng = random.Random(seed)
    spark = df.sparkSession
    probes = spark.createDataFrame([(-1 - i, [rng.uniform(r["a"], r["b"]) for r in dims]) for i in range(sample)], "i long, u array<double>")
    own = df.orderBy(F.xxhash64(row_id, F.lit(seed))).limit(sample).select(F.col(row_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("u"))
    q = F.broadcast(own.unionByName(probes))  # at most twice the sample
    d = df.select(F.col(row_id).alias("j"), F.col(vector).alias("v")).join(q, F.col("i") != F.col("j")).groupBy("i").agg(F.min(_array_distance("u", "v")).alias("d"))
    row = d.agg(F.sum(F.when(F.col("i") < 0, F.col("d"))).alias("u"), F.sum(F.when(F.col("i") >= 0, F.col("d"))).alias("w")).first()
    return row["u"] / (row["u"] + row["w"])
