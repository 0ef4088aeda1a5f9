"""Explanations of models that predict by adding a column."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.frame import clean, settled
from tessella.functions.specfun import t_quantile
from tessella.operators.trees import Node

Predict = Callable[[DataFrame], DataFrame]


#: Rows of a piece of the order, and leading bits of a hash, whose values stay together.
PIECE, BITS = 1 << 16, 12


def _packed(a: pa.Array | pa.RecordBatch) -> bytes:
    batch = a if isinstance(a, pa.RecordBatch) else pa.record_batch([a], ["v"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(x: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(x.as_buffer()).read_next_batch()


def _pieces(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows by ranges of the first column, sorted and packed: (piece, data), the first row of each range, the first piece of each.

    Pieces count on from range to range; those of a range hold PIECE rows, the last one what is left.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = piece = 0
        row = lambda: pa.RecordBatch.from_pydict({"at": [piece], "n": [size], "data": pa.array([_packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])], pa.binary())})
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, PIECE - size))
                size, batch = size + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if size == PIECE:
                    yield row()
                    held, size, piece = [], 0, piece + 1
        if size:
            yield row()

    packed = settled(df.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(pack, "at long, n long, data binary").withColumn("part", F.spark_partition_id()))
    found = sorted(packed.groupBy("part").agg(F.sum("n"), F.count("*")).collect())
    starts, first = (np.cumsum([0, *[r[i] for r in found]]) for i in (1, 2))
    named = df.sparkSession.createDataFrame([(r["part"], int(k)) for r, k in zip(found, first)], "part int, first long")
    return packed.join(F.broadcast(named), "part").select((F.col("first") + F.col("at")).alias("piece"), "data"), starts, first


def _shuffled(df: DataFrame, pieces: tuple[DataFrame, np.ndarray, np.ndarray], column: str, row_id: str, seed: int) -> DataFrame:
    """The packed rows, where the row at a place of their order has the value at that place of a hashed order.

    Hashes are dealt by their leading bits; the counts of those give each value its place.
    """
    packed, starts, first = pieces
    values = df.select(F.xxhash64(row_id, F.lit(column), F.lit(seed)).alias("h"), F.col(row_id).alias("id"), F.col(column).alias("v"))
    lead = F.shiftright("h", 64 - BITS).cast("int")
    begin, n = {}, 0
    for r in sorted(values.groupBy(lead.alias("b")).agg(F.count("*").alias("n")).collect()):
        begin[r["b"]], n = n, n + r["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            b, v = batch.column(0).to_numpy(), batch.column(1)
            for low, high in itertools.pairwise([0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]):
                if low < high and b[low] != now:
                    now = b[low]
                    at = begin[int(now)]
                while low < high:
                    part = int(np.searchsorted(starts, at, "right")) - 1
                    piece, skip = divmod(at - int(starts[part]), PIECE)
                    k = min(high - low, PIECE - skip, int(starts[part + 1]) - at)
                    yield pa.RecordBatch.from_pydict({"piece": [int(first[part]) + piece], "at": [skip], "data": pa.array([_packed(v.slice(low, k))], pa.binary())})
                    low, at = low + k, at + k

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            for at, data in zip(batch.column(0), batch.column(1)):
                found = _unpacked(data)
                if at.as_py() >= 0:  # a piece's values come first
                    held.append(found.column(0))
                    continue
                i = found.schema.get_field_index(column)
                yield found.set_column(i, found.schema.field(i), pa.concat_arrays(held))
                held = []

    dealt = values.repartition(lead).sortWithinPartitions("h", "id", "v").select(lead.alias("b"), "v").mapInArrow(place, "piece long, at long, data binary")
    # the rows have the place PIECE as seen by the sort, -1 as seen by fill
    both = dealt.unionByName(packed.select("piece", F.lit(PIECE).cast("long").alias("at"), "data"))
    met = both.repartition("piece").sortWithinPartitions("piece", "at").select(F.when(F.col("at") < PIECE, F.col("at")).otherwise(-1).alias("at"), "data")
    return met.mapInArrow(fill, df.schema)


def permutation_importance(predict: Predict, df: DataFrame, columns: Sequence[str], target: str, score: Callable[[DataFrame, str, str], float], row_id: str, repeats: int = 5, seed: int = 0) -> dict[str, tuple[float, float, float, float]]:
    """Mean, deviation and t interval of the score's fall when a column is shuffled.

    The shuffle gives rows in id order the values in hashed order. Rows are sorted and
    stored once, with all columns of ``df``; a shuffle sorts the values alone.
    """
    base = score(predict(df), target, "prediction")
    pieces = _pieces(df, list(dict.fromkeys([row_id, *columns, target])))
    found = {}
    for c in columns:
        falls = [base - score(predict(_shuffled(df, pieces, c, row_id, seed + r)), target, "prediction") for r in range(repeats)]
        m = sum(falls) / repeats
        s = math.sqrt(sum((x - m) ** 2 for x in falls) / max(repeats - 1, 1))
        half = t_quantile(0.975, repeats - 1) * s / math.sqrt(repeats) if repeats > 1 else 0.0
        found[c] = m, s, m - half, m + half
    return found


def grid_of(df: DataFrame, column: str, n: int = 20, method: str = "percentile") -> list[float]:
    if method == "uniform":
        a, b = df.agg(F.min(clean(column)), F.max(clean(column))).first()
        return [a + (b - a) * i / (n - 1) for i in range(n)]
    q = df.agg(F.percentile(clean(column), F.array(*[F.lit(i / (n - 1)) for i in range(n)]))).first()[0]
    return sorted(set(q))


def ice(predict: Predict, df: DataFrame, column: str, grid: Sequence[float]) -> DataFrame:
    """All rows at all grid values: columns grid_value and prediction."""
    return predict(df.withColumn("grid_value", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn(column, F.col("grid_value")))


def partial_dependence(predict: Predict, df: DataFrame, column: str, grid: Sequence[float]) -> DataFrame:
    """(grid_value, mean, std) of predictions with the column set to each grid value."""
    return ice(predict, df, column, grid).groupBy("grid_value").agg(F.avg("prediction").alias("mean"), F.stddev_samp("prediction").alias("std"))


def centred_ice(predict: Predict, df: DataFrame, column: str, grid: Sequence[float], row_id: str) -> DataFrame:
    """(row_id, grid_value, prediction, centred, slope)."""
    w = Window.partitionBy(row_id).orderBy("grid_value")
    p, g = F.col("prediction"), F.col("grid_value")
    return ice(predict, df, column, grid).select(row_id, "grid_value", "prediction", (p - F.first("prediction").over(w)).alias("centred"), ((p - F.lag("prediction").over(w)) / (g - F.lag("grid_value").over(w))).alias("slope"))


def partial_dependence_2d(predict: Predict, df: DataFrame, a: str, b: str, grid_a: Sequence[float], grid_b: Sequence[float]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in itertools.product(grid_a, grid_b)])
    at = df.withColumn("__g", F.explode(cells)).withColumn("grid_a", F.col("__g.x")).withColumn("grid_b", F.col("__g.y")).withColumn(a, F.col("grid_a")).withColumn(b, F.col("grid_b")).drop("__g")
    return predict(at).groupBy("grid_a", "grid_b").agg(F.avg("prediction").alias("mean"))


def h_statistic(predict: Predict, df: DataFrame, a: str, b: str, points: int = 10) -> float:
    """Friedman's H squared of two columns on a percentile grid."""
    ga, gb = grid_of(df, a, points), grid_of(df, b, points)
    pa = {r["grid_value"]: r["mean"] for r in partial_dependence(predict, df, a, ga).collect()}
    pb = {r["grid_value"]: r["mean"] for r in partial_dependence(predict, df, b, gb).collect()}
    both = {(r["grid_a"], r["grid_b"]): r["mean"] for r in partial_dependence_2d(predict, df, a, b, ga, gb).collect()}
    x = np.array([[both[u, v] for v in gb] for u in ga])
    u, v = np.array([pa[g] for g in ga]), np.array([pb[g] for g in gb])
    x, u, v = x - x.mean(), u - u.mean(), v - v.mean()
    total = float((x**2).sum())
    return float(((x - u[:, None] - v) ** 2).sum()) / total if total > 0 else 0.0


def h_matrix(predict: Predict, df: DataFrame, columns: Sequence[str], points: int = 6) -> dict[tuple[str, str], float]:
    return {(a, b): h_statistic(predict, df, a, b, points) for a, b in itertools.combinations(columns, 2)}


def _tree_shap(node: Node, x: dict[str, float], columns: Sequence[str], value: Callable[[Node], float]) -> np.ndarray:
    """Shapley values of one tree's conditional expectations: each leaf's product over the columns on its path."""
    phi, index = np.zeros(len(columns)), {c: j for j, c in enumerate(columns)}

    def walk(n: Node, path: dict[str, tuple[float, float]]):
        if n.feature is None:
            v, items = value(n), list(path.items())
            m = len(items)
            for i, (c, (zero, one)) in enumerate(items):
                # coefficients by size of coalitions of the other columns
                poly = np.array([1.0])
                for k, (_, (z, o)) in enumerate(items):
                    if k != i:
                        poly = np.convolve(poly, [z, o])
                weights = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
                phi[index[c]] += v * (one - zero) * float(poly @ weights)
            return
        known = x[n.feature]
        missing = known is None or (isinstance(known, float) and math.isnan(known))
        goes = n.default_left if missing else known <= n.threshold
        for child, hit in ((n.left, goes), (n.right, not goes)):
            zero, one = path.get(n.feature, (1.0, 1.0))
            walk(child, path | {n.feature: (zero * child.n / max(n.n, 1e-300), one * hit)})

    walk(node, {})
    return phi


def tree_shap(trees: Sequence[Node], df: DataFrame, columns: Sequence[str], row_id: str, value: Callable[[Node], float] = lambda n: float(n.value), scale: float = 1.0) -> DataFrame:
    """(row_id, base, shap_<column>..): exact path-dependent values, by batches with the trees shipped along."""
    columns = list(columns)

    def expected(n: Node) -> float:
        return value(n) if n.feature is None else (expected(n.left) * n.left.n + expected(n.right) * n.right.n) / max(n.n, 1e-300)

    base = scale * sum(expected(t) for t in trees)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [scale * sum(_tree_shap(t, r, columns, value) for t in trees) for r in pdf[columns].to_dict("records")]
            made = np.array(rows).reshape(len(pdf), len(columns))
            yield pd.DataFrame({row_id: pdf[row_id], "base": base} | {f"shap_{c}": made[:, j] for j, c in enumerate(columns)})

    schema = f"{row_id} {df.schema[row_id].dataType.simpleString()}, base double, " + ", ".join(f"shap_{c} double" for c in columns)
    return df.select(row_id, *[clean(c).alias(c) for c in columns]).mapInPandas(each, schema)


def kernel_shap(predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, x: np.ndarray, n_coalitions: int | None = None, seed: int = 0) -> tuple[float, np.ndarray]:
    """Base value and Shapley values of one row by weighted least squares over coalitions; all of them up to 2^12."""
    m = len(x)
    rng = np.random.default_rng(seed)
    n = n_coalitions or 2 * m + 2048
    if 2**m <= max(n, 4096):
        z = np.array(list(itertools.product((0, 1), repeat=m)), float)
    else:
        z = (rng.random((n, m)) < rng.random((n, 1))).astype(float)
    size = z.sum(1)
    weight = np.array([1e6 if s in (0, m) else (m - 1) / (math.comb(m, int(s)) * s * (m - s)) for s in size])
    y = np.array([predict(np.where(mask > 0, x, background)).mean() for mask in z])
    base, full = float(predict(background).mean()), float(predict(x[None]).mean())
    a, b = np.hstack([np.ones((len(z), 1)), z]), y
    s = np.sqrt(weight)[:, None]
    beta = np.linalg.lstsq(a * s, b * s[:, 0], rcond=None)[0]
    phi = beta[1:]
    return base, phi + (full - base - phi.sum()) / m


def shap_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean_abs, mean, std) of shap_<column> columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"shap_{c}").alias("v")) for c in columns])).alias("s")).select("s.*")
    return long.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
