"""The ways that only large tables take, on small ones."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella import frame
from tessella.operators import cluster, explain, kernels, linear, pairs, splits, stats, text


def test_ranks_by_ranges_of_the_order(spark, monkeypatch):
    rows = [(i % 7 < 3, float(i * 37 % 50)) for i in range(120)]
    df = spark.createDataFrame([("a" if g else "b", x) for g, x in rows], "g string, x double")
    whole = stats.mann_whitney_u(df, "x", "g", "a", "b").first()
    monkeypatch.setattr(stats, "in_order", partial(frame.in_order, limit=5))
    assert stats.mann_whitney_u(df, "x", "g", "a", "b").first() == whole
    ranks = {r.x: r["rank"] for r in stats.average_ranks(df, F.col("x")).collect()}
    values = sorted(x for _, x in rows)
    assert all(ranks[x] == values.index(x) + (values.count(x) + 1) / 2 for x in set(values))


def test_rank_test_by_ranges_of_the_order(spark, monkeypatch):
    df = spark.createDataFrame([("ab"[i % 3 == 0], float(i * 37 % 50)) for i in range(120)], "g string, x double")
    whole = stats.mann_whitney_test(df, "x", "g", "a", "b")
    monkeypatch.setattr(stats, "in_order", partial(frame.in_order, limit=5))
    assert stats.mann_whitney_test(df, "x", "g", "a", "b") == whole


@pytest.mark.parametrize("few", [1, 20_000])
def test_exact_quantile(spark, few):
    rng = np.random.default_rng(0)
    heaps = [*rng.normal(0, 1, 50), *(1e9 + rng.normal(0, 1, 50))]
    for x in ([3.0], [1.0, 2.0], [5.0] * 30, heaps, [*rng.normal(0, 1, 201), 1e300, -1e300], [float("inf"), 1.0, 2.0], rng.integers(0, 5, 400).tolist()):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        for q in (0.0, 0.25, 0.5, 1.0):
            want = df.agg(F.percentile("x", F.lit(q))).first()[0]
            assert frame.exact_quantile(df, F.col("x"), q, few) == pytest.approx(want, rel=1e-12)
    assert frame.exact_quantile(df.limit(0), F.col("x")) is None


@pytest.mark.parametrize("kind", ["bisquare", "andrews", "hampel", "huber"])
def test_robust_fit_sorts_no_residuals(spark, kind, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), float(2 * x + e)) for x, e in rng.normal(0, 1, (200, 2))], "x double, y double")

    def never(*_):
        raise AssertionError("a table of all residuals")

    monkeypatch.setattr(linear.F, "percentile", never)
    assert abs(linear.RobustRegression(kind).fit(df, ["x"], "y").coefficients[0] - 2) < 0.3


@pytest.mark.parametrize("kind", ["bisquare", "andrews"])
def test_robust_rounds_pass_over_rows_once(spark, kind, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.integers(0, 50, 400).astype(float)
    y = 3 * x + rng.standard_cauchy(400)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 5.0), (7.0, None), (float("nan"), 1.0)]
    asked = []
    monkeypatch.setattr(linear, "exact_quantile", lambda *a: asked.append(1) or frame.exact_quantile(*a))
    m = linear.RobustRegression(kind, max_iter=10).fit(spark.createDataFrame(rows, "x double, y double"), ["x"], "y")
    a = np.column_stack((np.ones(400), x))
    start = linear.LinearRegression().fit(spark.createDataFrame(rows, "x double, y double"), ["x"], "y")
    beta = np.array([start.intercept, *start.coefficients])
    for _ in range(10):
        e = y - a @ beta
        scale = np.median(np.abs(e - np.median(e))) / 0.6745
        u = np.abs(e / scale)
        w = np.where(u <= 4.685, (1 - (u / 4.685) ** 2) ** 2, 0) if kind == "bisquare" else np.where(u <= 1.339 * np.pi, np.sinc(u / 1.339 / np.pi), 0)
        new = np.linalg.solve((a.T * w) @ a, (a.T * w) @ y)
        moved, beta = np.abs(new - beta).max(), new
        if moved < 1e-6:
            break
    assert np.allclose([m.intercept, *m.coefficients, m.scale], [*beta, scale], rtol=1e-9)
    assert len(asked) == 2  # one median and one deviation from all rows


@pytest.mark.parametrize("near", [40, 10_000])
def test_medians_after_steps(spark, near, monkeypatch):
    monkeypatch.setattr(linear, "NEAR", near)
    rng = np.random.default_rng(11)
    for n, digits in ((2, 3), (201, 0)):  # few rows, ties
        x, y = rng.normal(0, 5, n).round(digits), rng.normal(0, 20, n).round(digits)
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").coalesce(1).cache()
        medians, beta = linear.Medians(df, linear.design(["x"], True), "y"), np.array([1.0, 2.0])
        for size in (0, 3, 0.3, 0.01, 9):
            beta = beta + size * rng.normal(0, 1, 2)
            e = y - beta[0] - beta[1] * x
            assert np.allclose(medians.of(beta), (np.median(e), np.median(np.abs(e - np.median(e)))), atol=1e-9)


def merged(x, k, linkage):
    """Merges of the closest pair, one by one."""
    parts = [[i] for i in range(len(x))]

    def gap(a, b):
        d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(-1))
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        return {"complete": d.max, "average": d.mean, "single": d.min}[linkage]()

    while len(parts) > k:
        i, j = min(((i, j) for j in range(len(parts)) for i in range(j)), key=lambda p: gap(parts[p[0]], parts[p[1]]))
        parts[i] = parts[i] + parts.pop(j)
    return {i: c for c, p in enumerate(sorted(parts, key=min)) for i in p}


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_hierarchies_over_copies(spark, linkage):
    x = np.random.default_rng(2).normal(0, 1, (25, 2))
    x = np.concatenate([x, x[:10]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    assert {r.id: r.cluster for r in cluster.agglomerative(df, ["a", "b"], 4, linkage).collect()} == merged(x, 4, linkage)
    assert len({r.cluster for r in cluster.agglomerative(df, ["a", "b"], 30, linkage).collect()}) == 30
    copies = df.select("id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(149))).alias("k")).selectExpr("k * 35 + id AS id", "a", "b")
    assert cluster.agglomerative(copies, ["a", "b"], 4, linkage).groupBy("cluster").count().count() == 4  # 5,250 rows


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_hierarchies_without_a_matrix(spark, linkage, monkeypatch):
    for name, small in (("FEW", 7), ("LEAF", 4), ("HELD", 60)):
        monkeypatch.setattr(cluster, name, small)
    x = np.random.default_rng(12).normal(0, 1, (60, 2)) * np.repeat([[0.1], [1], [3]], 20, axis=0)
    x = np.concatenate([x, x[::3]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    for k in (3, 9):
        assert {r.id: r.cluster for r in cluster.agglomerative(df, ["a", "b"], k, linkage, max_rows=50).collect()} == merged(x, k, linkage)
    grid = df.selectExpr("id", "cast(id % 9 AS double) AS a", "cast(floor(id / 9) AS double) AS b")  # nothing but ties
    assert cluster.agglomerative(grid, ["a", "b"], 5, linkage).groupBy("cluster").count().count() == 5


def test_hdbscan_beyond_3000_rows(spark):
    x = np.random.default_rng(3).normal(0, 0.1, (3200, 2)) + np.repeat([[0, 0], [5, 5]], 1600, axis=0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    found = {r.id: r.cluster for r in cluster.hdbscan(df, ["a", "b"], 400).collect()}
    sides = [{found[i] for i in range(at, at + 1600)} - {-1} for at in (0, 1600)]
    assert len(found) == 3200 and all(sides) and not sides[0] & sides[1]


def test_hdbscan_on_executors(spark, monkeypatch):
    for name, small in (("ALONE", 100), ("QUERIES", 41), ("ROWS", 97), ("KNOWN", 8)):
        monkeypatch.setattr(cluster, name, small, raising=False)
    rng = np.random.default_rng(14)
    x = rng.normal(0, 1, (300, 3)) + np.repeat([[0], [40], [90]], 100, axis=0)
    x[290:] = x[:10]  # copies
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(near, axis=1)[:, 4]
    reach, inside, want = np.maximum(near, np.maximum(core[:, None], core)), [0], []
    while len(inside) < 300:
        rest = np.setdiff1d(np.arange(300), inside)
        gap = reach[np.ix_(inside, rest)]
        want.append(gap.min())
        inside.append(int(rest[gap.min(0).argmin()]))

    def never(*_):
        raise AssertionError("the driver compares all rows")

    monkeypatch.setattr(cluster, "_spanning_tree", never)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    found = {r.id: r.cluster for r in cluster.hdbscan(df, ["a", "b", "c"], 30, 4).collect()}
    sides = [{found[i] for i in range(at, min(at + 100, 290))} - {-1} for at in (0, 100, 200)]
    assert len(found) == 300 and [len(s) for s in sides] == [1, 1, 1] and len(set.union(*sides)) == 3
    edges = cluster._reachability_tree(spark, x, 4)
    assert len({(a, b) for _, a, b in edges}) == 299 and np.allclose(sorted(w for w, _, _ in edges), sorted(want))


def test_network_takes_more_than_50000_rows(spark):
    df = spark.range(60_000).selectExpr("cast(id % 97 AS double) AS a", "cast(id % 97 > 48 AS int) AS y")
    assert kernels.MLP((4,), epochs=2).fit(df, ["a"], "y").predict(df).filter("prediction = y").count() > 54_000


def test_kernel_machine_over_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 2))
    df = spark.createDataFrame([(i, *map(float, v), int(v[0] + v[1] + e > 0)) for i, (v, e) in enumerate(zip(x, rng.normal(0, 0.8, 60)))], "id long, a double, b double, y int")
    copies = df.select("id", "a", "b", "y", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("k"))  # 3,600 rows

    def decisions(model):
        return np.array([r.decision for r in model.predict(df).orderBy("id").collect()])

    whole = decisions(kernels.SVC(1.0, tol=1e-7).fit(copies, ["a", "b"], "y"))
    assert np.allclose(whole, decisions(kernels.SVC(60.0, tol=1e-7).fit(df, ["a", "b"], "y")), atol=1e-4)
    few = kernels.SVC(60.0, tol=1e-7)
    few.CACHED = 200  # a few columns
    assert np.allclose(whole, decisions(few.fit(df, ["a", "b"], "y")), atol=1e-4)


@pytest.mark.parametrize("kernel", [kernels.Kernel("rbf", 2.0), kernels.Kernel("matern", 1.0), kernels.Kernel("rbf", 2.0) + kernels.Kernel("matern", 0.5, nu=0.5), kernels.Kernel("rbf", 1.0) + kernels.Kernel("constant")])
def test_gaussian_process_by_cells(spark, kernel):
    rng = np.random.default_rng(5)
    x = np.column_stack((rng.uniform(0, 400, 300), rng.normal(0, 1, 300)))
    x[:, 0] += np.where(x[:, 0] > 250, 300, 0)  # empty cells
    y, q = np.sin(x[:, 0]) + x[:, 1], np.column_stack((np.linspace(-20, 760, 101), np.zeros(101)))
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, y double")
    m = kernels.GaussianProcessRegressor(kernel, 0.1).fit(df, ["a", "b"], "y")
    z, k, at = (y - y.mean()) / y.std(), kernel(x, x) + 0.1 * np.eye(300), kernel(q, x)
    mean = at @ np.linalg.solve(k, z) * y.std() + y.mean()
    var = kernel(q[:1], q[:1].copy())[0, 0] - (at * np.linalg.solve(k, at.T).T).sum(1)
    got = m.predict(spark.createDataFrame([tuple(map(float, v)) for v in q], "a double, b double").coalesce(1)).orderBy("a").collect()
    assert np.allclose([r.prediction for r in got], mean, atol=1e-8) and np.allclose([r["std"] for r in got], np.sqrt(var) * y.std(), atol=1e-8)
    assert np.isclose(m.log_likelihood, -0.5 * z @ np.linalg.solve(k, z) - np.linalg.slogdet(k)[1] / 2 - 150 * np.log(2 * np.pi))


def test_gaussian_process_beyond_3000_rows(spark):
    df = spark.range(4000).selectExpr("cast(id AS double) AS x", "sin(id / 50) AS y")
    found = kernels.GaussianProcessRegressor(kernels.Kernel("rbf", 10.0), 0.1).fit(df, ["x"], "y").predict(df)
    assert found.count() == 4000 and found.filter("abs(prediction - y) < 0.05").count() > 3900


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_sparse_distances_by_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(text, "SPARSE_BLOCK", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1e4, (30, 600)) * (rng.random((30, 600)) < 0.05)
    x[8], x[20], x[21] = x[3], x[3], 0  # copies in other blocks, a row without entries
    m = text.SparseMatrix(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, column long, value double"), 30, 600)
    found = m.distances(m, metric)
    assert "Generate" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and plan.count("SortMergeJoin") + plan.count("HashJoin") == 0  # no join of values
    got = {(r["query"], r["row"]): r["distance"] for r in found.collect()}
    gap, one = np.abs(x[:, None] - x[None]), x != 0
    if metric == "cosine":
        want = {(i, j): 1 - x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) for i in range(30) for j in range(30) if (one[i] & one[j]).any()}
    else:
        d = np.sqrt((gap**2).sum(-1)) if metric == "euclidean" else gap.sum(-1)
        want = {(i, j): d[i, j] for i in range(30) for j in range(30)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-7 for k in want)
    if metric != "cosine":
        assert got[3, 8] == got[3, 20] == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_sparse_distances_of_equal_rows(spark, monkeypatch, metric):
    monkeypatch.setattr(text, "SPARSE_BLOCK", 8)
    rng = np.random.default_rng(13)
    x = np.tile(rng.normal(0, 9, (10, 5)) * (rng.random((10, 5)) < 0.8), (4, 1))
    x[:, 0] = 2.0
    m = text.SparseMatrix(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, column long, value double"), 40, 5)
    found = m.distances(m, metric, 4)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()  # blocks are dealt to groups, not to pairs
    rows = found.collect()
    gap, size = x[:, None] - x[None], np.sqrt((x**2).sum(1))
    want = {"cosine": 1 - x @ x.T / np.outer(size, size), "euclidean": np.sqrt((gap**2).sum(-1)), "manhattan": np.abs(gap).sum(-1)}[metric]
    assert len(rows) == len({(r["query"], r["row"]) for r in rows}) == 1600
    assert all(abs(r.distance - want[r["query"], r["row"]]) < 6e-5 and r.distance == round(r.distance, 4) for r in rows)
    after = [b["row"] % 10 == a["row"] % 10 for a, b in zip(rows, rows[1:]) if a["query"] == b["query"]]
    assert sum(after) > len(after) / 2  # copies lie together


def test_folds_by_cuts(spark, monkeypatch):
    ids = np.random.default_rng(7).permutation(50)
    df = spark.createDataFrame([(int(i) * 3,) for i in ids], "id long")
    want = {r.id: r.fold for r in splits.kfold(df, 4, ["id"]).collect()}
    tied = spark.createDataFrame([(int(i) // 9,) for i in ids], "id long")
    sizes = sorted(r["count"] for r in splits.kfold(tied, 4, ["id"], limit=10).groupBy("fold").count().collect())

    def never(*_):
        raise AssertionError("rows are numbered")

    monkeypatch.setattr(splits, "in_order", never)
    assert {r.id: r.fold for r in splits.kfold(df, 4, ["id"], limit=10).collect()} == want and sizes == [12, 12, 13, 13]


def test_close_pairs_at_the_edge():
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 10, (150, 3)).astype(float)
    for shift in (0.0, 1e6, 1e200):
        a = x + shift
        for eps in (0.0, 3.0, 5.0, float(np.sqrt(14))):
            assert (pairs.close(a, a[::-1], eps) == (pairs.distances(a, a[::-1]) <= eps)).all()


def test_dbscan_makes_no_row_for_a_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.25, (40, 2)) for c in (0, 2, 9)] + [rng.uniform(-3, 12, (40, 2))])
    ids = rng.permutation(len(x)) * 7
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.5
    core, label = near.sum(1) >= 5, {}
    for i in sorted(np.flatnonzero(core), key=lambda i: ids[i]):
        if i not in label:
            work, label[i] = [i], len(set(label.values()))
            while work:
                found = [j for j in np.flatnonzero(near[work.pop()] & core) if j not in label]
                label |= dict.fromkeys(found, label[i])
                work += found
    want = {int(ids[i]): int(label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1))) for i in range(len(x))}
    df = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x)], "id long, vector array<double>")

    def never(*_):
        raise AssertionError("a row for each link")

    monkeypatch.setattr(cluster.DBSCAN, "links", never)
    monkeypatch.setattr(pairs, "BLOCK", 13)
    model = cluster.DBSCAN(0.5, 5)
    assert {r.id: r.cluster for r in model.fit_predict(df).collect()} == want and len(set(want.values())) > 3
    assert {r.id: r.n for r in model.core_points(df).collect()} == {int(ids[i]): int(near[i].sum()) for i in np.flatnonzero(core)}


def test_shuffles_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(explain, "PIECE", 7)


    df = spark.range(100).selectExpr("id * 3 AS id", "cast(nullif(id % 17, 5) AS double) AS a", "cast(id AS double) AS y", "concat('t', id) AS t").repartition(3)
    seen = []

    def score(d, y, p):
        seen.append({r.id: (r.a, r.y, r.t) for r in d.collect()})
        return 0.0

    explain.permutation_importance(lambda d: d, df, ["a"], "y", score, "id", 2)
    rows = sorted(df.collect())
    for k, found in enumerate(seen[1:]):
        hashed = df.orderBy(F.xxhash64("id", F.lit("a"), F.lit(k)), "id").collect()
        assert found == {r.id: (h.a, r.y, r.t) for r, h in zip(rows, hashed)}
