"""Block-wise distances against all pairs."""

import numpy as np
import pytest
from tessella.errors import InvalidInput
from tessella.operators import neighbors, pairs


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski"])
def test_nearest_rows(spark, monkeypatch, metric):
    monkeypatch.setattr(pairs, "BLOCK", 17)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (90, 3)).astype(float)  # many ties
    rows = [(i, x[i].tolist()) for i in range(90)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    d = np.abs(x[:, None] - x[None])
    d = {"euclidean": np.sqrt((d**2).sum(-1)), "manhattan": d.sum(-1), "minkowski": (d**3).sum(-1) ** (1 / 3)}[metric]
    np.fill_diagonal(d, np.inf)
    want = sorted((i, int(j), r + 1) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), d[i].round(12)))[:4]))
    got = neighbors.neighbors(df, df, 4, metric=metric, exclude_self=True, p=3.0)
    assert sorted((r.query, r.neighbor, r["rank"]) for r in got.collect()) == want
    with pytest.raises(InvalidInput):
        neighbors.neighbors(df, df, 4, metric="none")


def test_sums_and_links(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 13)
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (50, 2)), rng.integers(0, 3, 50)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(50)], "id long, vector array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    links = pairs.reduce_pairs(df, df, pairs.within(0.7), "i long, j long", "id", "vector")
    assert sorted(map(tuple, links.collect())) == sorted(zip(*np.nonzero(d <= 0.7)))
    sums = pairs.reduce_pairs(df, df, pairs.sums_by_label(), "i long, k long, l long, s double, n long", "id", "vector", "label").groupBy("i", "l").sum("s", "n").collect()
    assert len(sums) == 150 and all(np.isclose(r["sum(s)"], d[r.i][y == r.l].sum()) and r["sum(n)"] == (y == r.l).sum() for r in sums)
    assert pairs.reduce_pairs(df.limit(0), df, pairs.within(1.0), "i long, j long", "id", "vector").count() == 0
