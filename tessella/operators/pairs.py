"""Distances between all rows of two tables, block against block in numpy.

Rows are packed into blocks of a fixed number; what is joined are blocks. A function
reduces each pair of blocks at once (to nearest rows, sums or close pairs), so pairs of
rows never become rows of a table. Rows without a vector take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import settled

#: Rows of a block, query blocks that a task holds, and numbers that a step of a distance computation holds.
BLOCK, GROUP, STEP = 4096, 8, 1 << 22

#: (ids, vectors, labels) of queries and of rows to columns of the result.
Reduce = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]

#: Columns of several results to those of one.
Fold = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 2.0) -> np.ndarray:
    """All distances, from the differences of coordinates."""
    if metric not in ("euclidean", "manhattan", "minkowski"):
        raise InvalidInput(f"no metric {metric}")
    out = np.empty((len(a), len(b)))
    step = max(1, STEP // max(1, b.size))
    for at in range(0, len(a), step):
        gap = np.abs(a[at : at + step, None, :] - b[None])
        if metric == "euclidean":
            out[at : at + step] = np.sqrt((gap * gap).sum(-1))
        else:
            out[at : at + step] = gap.sum(-1) if metric == "manhattan" else (gap**p).sum(-1) ** (1 / p)
    return out


def close(a: np.ndarray, b: np.ndarray, eps: float, metric: str = "euclidean") -> np.ndarray:
    """Which distances are at most eps.

    Products decide all pairs but those that their rounding could turn, differences the rest.
    """
    with np.errstate(all="ignore"):
        own, sq = (a * a).sum(1), (b * b).sum(1)
        slack = 1e-9 * (own.max(initial=0) + sq.max(initial=0))
    if metric != "euclidean" or eps < 0 or not np.isfinite(slack):
        return distances(a, b, metric) <= eps
    out = np.empty((len(a), len(b)), bool)
    left, right = np.column_stack((a, own, np.ones(len(a)))), np.column_stack((-2 * b, np.ones(len(b)), sq)).T.copy()
    step, few = max(1, STEP // 8 // max(1, len(b))), max(1, STEP // max(1, a.shape[1]))
    for at in range(0, len(a), step):
        rough = left[at : at + step] @ right
        near = rough <= eps * eps + slack
        i, j = np.nonzero(near ^ (rough < eps * eps - slack))
        for k in range(0, len(i), few):
            gap = a[at + i[k : k + few]] - b[j[k : k + few]]
            near[i[k : k + few], j[k : k + few]] = np.sqrt((gap * gap).sum(1)) <= eps
        out[at : at + step] = near
    return out


def _blocks(df: DataFrame, row_id: str, vec: str, label: str | None) -> DataFrame:
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("y")).filter("v IS NOT NULL AND id IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: table.column(c).chunk(0)
            return pa.RecordBatch.from_pydict({k: pa.array([x], pa.binary()) for k, x in (("id", column("id").to_numpy().tobytes()), ("v", column("v").values.to_numpy(zero_copy_only=False)[column("v").offsets[0].as_py() : column("v").offsets[-1].as_py()].tobytes()), ("y", column("y").to_numpy(zero_copy_only=False).tobytes()))})

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if size + part.num_rows > BLOCK and held:
                    yield row()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield row()

    n = rows.count()
    dealt = rows.repartition(max(1, -(-n // BLOCK)))
    return settled(dealt.mapInArrow(pack, "id binary, v binary, y binary").withColumn("part", F.spark_partition_id()))


def reduce_pairs(queries: DataFrame, rows: DataFrame, function: Reduce, schema: str, row_id: str, vec: str, label: str | None = None, fold: Fold | None = None) -> DataFrame:
    """What ``function`` gives for every block of queries with every block of rows; a task joins what it found by ``fold``.

    A task holds a group of query blocks and reads a group of row blocks one by one, so a
    block of rows is sent once for each group of queries, not for each block.
    """
    left, right = _blocks(queries, row_id, vec, label), _blocks(rows, row_id, vec, label)
    n_left, n_right = max(1, left.count()), max(1, right.count())
    spark = queries.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q_groups = min(n_left, max(-(-n_left // GROUP), int((2 * cores) ** 0.5)))
    r_groups = min(n_right, -(-2 * cores // q_groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = left.withColumn("kind", F.lit(0)).withColumn("i", F.pmod("part", F.lit(q_groups))).withColumn("j", every(r_groups))
    gives = right.withColumn("kind", F.lit(1)).withColumn("j", F.pmod("part", F.lit(r_groups))).withColumn("i", every(q_groups))
    columns = [(F.col("i").cast("long") * r_groups + F.col("j")).alias("task"), "kind", "id", "v", "y"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, held = None, [], None
        row = lambda found: pa.RecordBatch.from_pydict({k: pa.array(x) for k, x in found.items()})
        for batch in batches:
            for task, kind, *raw in zip(*(batch.column(i) for i in range(5))):
                if task.as_py() != now:
                    now, asked = task.as_py(), []
                ids, v, y = (np.frombuffer(x.as_buffer(), "<f8" if k == 1 else "<i8") for k, x in enumerate(raw))
                if not kind.as_py():  # a task's queries come first
                    asked.append((ids.copy(), v.reshape(len(ids), -1).copy(), y.copy()))
                    continue
                for qi, qv, qy in asked:
                    found = function(qi, qv, qy, ids, v.reshape(len(ids), -1), y)
                    if not fold:
                        yield row(found)
                    else:
                        held = fold({k: np.concatenate((held[k], x)) for k, x in found.items()} if held else found)
        if held:
            yield row(held)

    dealt = asks.select(columns).unionByName(gives.select(columns)).repartitionByRange(q_groups * r_groups, "task")
    return dealt.sortWithinPartitions("task", "kind").mapInArrow(each, schema)


def nearest(k: int, metric: str = "euclidean", exclude_self: bool = False, p: float = 2.0) -> Reduce:
    """The k nearest rows of the block for each query, ties to the smaller id."""

    def reduce(qi, qv, _qy, ri, rv, _ry):
        who, ids, far = [], [], []
        step = max(1, STEP // max(1, len(ri)))
        for at in range(0, len(qi), step):
            q, own = qv[at : at + step], qi[at : at + step]
            if metric == "euclidean":
                # products give the few that can be near, differences their distances
                rough = (q * q).sum(1)[:, None] + (rv * rv).sum(1) - 2 * q @ rv.T
                slack = 1e-9 * (1 + (q * q).sum(1) + float((rv * rv).sum(1).max(initial=0)))
            else:
                rough, slack = distances(q, rv, metric, p), np.zeros(len(q))
            if exclude_self:
                rough[own[:, None] == ri] = np.inf
            kk = min(k, rough.shape[1])
            bar = np.partition(rough, kk - 1, axis=1)[:, kk - 1] + slack
            for i in range(len(q)):
                near = np.flatnonzero((rough[i] <= bar[i]) & (rough[i] < np.inf))
                d = distances(q[i : i + 1], rv[near], metric, p)[0]
                best = np.lexsort((ri[near], d))[:k]
                who.append(np.full(len(best), own[i]))
                ids.append(ri[near][best])
                far.append(d[best])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return {"query": join(who, np.int64), "neighbor": join(ids, np.int64), "distance": join(far, np.float64)}

    return reduce


def sums_by_label(metric: str = "euclidean") -> Reduce:
    """(i, k, l, s, n): a query's distances to the rows of each label, summed."""

    def reduce(qi, qv, qy, ri, rv, ry):
        labels, which = np.unique(ry, return_inverse=True)
        sums = np.zeros((len(qi), len(labels)))
        step = max(1, STEP // max(1, len(ri)))
        one = np.zeros((len(ri), len(labels)))
        one[np.arange(len(ri)), which] = 1
        for at in range(0, len(qi), step):
            sums[at : at + step] = distances(qv[at : at + step], rv, metric) @ one
        n = np.bincount(which, minlength=len(labels))
        return {"i": np.repeat(qi, len(labels)), "k": np.repeat(qy, len(labels)), "l": np.tile(labels, len(qi)), "s": sums.ravel(), "n": np.tile(n, len(qi))}

    return reduce


def ends_by_label(metric: str = "euclidean") -> Reduce:
    """One row a pair of blocks: the least distance between labels and the greatest within one (infinite and -1 where there is none)."""

    def reduce(qi, qv, qy, ri, rv, ry):
        least, most = np.inf, -1.0
        step = max(1, STEP // max(1, len(ri)))
        for at in range(0, len(qi), step):
            d = distances(qv[at : at + step], rv, metric)
            same = qy[at : at + step, None] == ry[None]
            least = min(least, float(d[~same].min(initial=np.inf)))
            most = max(most, float(d[same & (qi[at : at + step, None] != ri[None])].max(initial=-1.0)))
        return {"least": np.array([least]), "most": np.array([most])}

    return reduce


def within(eps: float, metric: str = "euclidean") -> Reduce:
    """(i, j): pairs at a distance of at most eps."""

    def reduce(qi, qv, _qy, ri, rv, _ry):
        x, y = np.nonzero(close(qv, rv, eps, metric))
        return {"i": qi[x], "j": ri[y]}

    return reduce


def counts_within(eps: float, metric: str = "euclidean") -> Reduce:
    """(i, n): the rows at a distance of at most eps, counted for each query."""
    return lambda qi, qv, _qy, ri, rv, _ry: {"i": qi, "n": close(qv, rv, eps, metric).sum(1)}


def summed(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """(i, n) with each i once."""
    ids, which = np.unique(found["i"], return_inverse=True)
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, which, found["n"])
    return {"i": ids, "n": n}


def forest(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """(i, j) of edges: each node once, with the least node that these edges reach."""
    ids, which = np.unique(np.concatenate((found["i"], found["j"])), return_inverse=True)
    a, b = np.split(which, 2)
    top = np.arange(len(ids))
    while True:
        low, new = np.minimum(top[a], top[b]), top.copy()
        for x in (a, b, top[a], top[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == top).all():
            return {"i": ids, "j": ids[top]}
        top = new


def forest_within(eps: float, metric: str = "euclidean") -> Reduce:
    """(i, j): each row with a least one that pairs of these blocks at a distance of at most eps reach."""

    def reduce(qi, qv, _qy, ri, rv, _ry):
        links = close(qv, rv, eps, metric)
        ask, give = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
        # a link for each row, then for each query one that leaves what it has reached
        found = forest({"i": np.concatenate((qi[ask], ri[give])), "j": np.concatenate((ri[links[ask].argmax(1)], qi[links.argmax(0)[give]]))})
        while len(np.unique(found["j"])) > 1:
            top = lambda x: found["j"][np.searchsorted(found["i"], x)]
            other = links[np.ix_(ask, give)] & (top(qi[ask])[:, None] != top(ri[give]))
            some = np.flatnonzero(other.any(1))
            if not len(some):
                break
            found = forest({"i": np.concatenate((found["i"], qi[ask][some])), "j": np.concatenate((found["j"], ri[give][other[some].argmax(1)]))})
        return found

    return reduce


def least_label_within(eps: float, metric: str = "euclidean") -> Reduce:
    """(i, y): the least label among the rows at a distance of at most eps, for queries that have one."""

    def reduce(qi, qv, _qy, ri, rv, ry):
        order = np.argsort(ry, kind="stable")
        near = close(qv, rv[order], eps, metric)
        some = near.any(1)
        return {"i": qi[some], "y": ry[order][near[some].argmax(1)]}

    return reduce
