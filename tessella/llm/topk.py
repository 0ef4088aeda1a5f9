"""Exact top-k search by aggregation without random access.

Vectors become integers, floor(64 * x). A block of candidates is stored as its lists
alone: for every dimension (candidate, value), sorted by value. A block of queries reads
all lists sequentially, step by step, each query from a list's best end: the top where
its own component is positive, the bottom where it is negative. Every candidate keeps

* an upper bound: what has been read, and for other lists the entry where reading stands;
* a lower bound: what has been read, and for other lists their worst entry.

The bar is the k-th best of resolved scores; a query that has none yet takes the k-th
best lower bound. A candidate whose upper bound is under the bar is an outsider and
drops out; a block whose best possible sum is under the bar isn't read at all. Reading
ends for a query when only candidates that can qualify are left; those are read on to
the lists' ends, where both bounds meet in the score. Bounds are kept from step to step.

A step changes bounds by (entry - bound before) for entries it reads and by (bound now -
bound before) for those it doesn't reach, so one product of that table with the queries
moves the bounds of a whole block of queries. While many candidates are left the table
is multiplied whole, afterwards only in the rows of those left.

Tasks take a group of query blocks through a group of candidate blocks, and a block's
lists are sorted once; groups' rankings are merged.

Scores are exact at any size: doubles where they hold all sums, 64-bit integers beyond,
Python's integers beyond those. A score outside 64 bits is given as the nearest long;
the order is that of the exact scores all the same.

Rows take no part if vec_id is null, or the vector is null or empty or holds a null or
non-finite component. A candidate of another length than a query's is none of its
candidates. Rows that share the query's vec_id are its own. Repeated query rows each get
a ranking, and repeated candidates a rank each, ties to the smaller vec_id. An empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import only, partitions, stage

SCALE, EVERY, K = 64, 20, 20
#: Components of a candidate block and of a query block; blocks of a group.
BLOCK, QUERIES, GROUP = 1 << 18, 1 << 14, 16
#: How far lists have been read after each step.
DEPTHS = (0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)
#: Rows are read on one query at a time when under this share of a block's candidates is left.
FEW = 1 / 8
_LONG = 1 << 63


def _lowest(kind: type):
    return -(1 << 62) if kind is np.int64 else -np.inf


class Lists:
    """A block of candidates: a list a dimension, in ascending order of value."""

    def __init__(self, ids: np.ndarray, order: np.ndarray, values: np.ndarray):
        self.ids, self.order, self.values = ids, order, values
        self.largest = max(abs(int(values.min())), abs(int(values.max())))
        self.steps: dict[tuple[type, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Lists:
        order = np.argsort(vectors, axis=0, kind="stable").T
        return cls(ids, order, np.take_along_axis(vectors.T, order, axis=1))

    def part(self, a: int, b: int) -> Lists:
        """The lists of some of the candidates, in the same order."""
        size = b - a
        inside = (self.order >= a) & (self.order < b)
        dim = len(self.order)
        return Lists(self.ids[a:b], self.order[inside].reshape(dim, size) - a, self.values[inside].reshape(dim, size))

    def read(self, kind: type, step: int) -> tuple[np.ndarray, np.ndarray]:
        """What a step adds to upper and lower bounds: from the top, then from the bottom."""
        if (kind, step) not in self.steps:
            values, order = self.values.astype(kind), self.order
            dim, size = values.shape
            column = np.arange(dim)[:, None]
            at, upto = (-int(-size * d // 1) for d in ((0, *DEPTHS)[step], DEPTHS[step]))
            upper, lower = np.zeros((size, 2 * dim), kind), np.zeros((size, 2 * dim), kind)
            # where reading stood and stands, from the top and from the bottom
            for place, before, now, reach, new, worst in ((0, size - max(at, 1), size - upto, slice(0, size - upto), slice(size - upto, size - at), 0), (dim, max(at, 1) - 1, upto - 1, slice(upto, size), slice(at, upto), size - 1)):
                upper[order[:, reach], column + place] = (values[:, now] - values[:, before])[:, None]
                upper[order[:, new], column + place] = values[:, new] - values[:, before, None]
                lower[order[:, new], column + place] = values[:, new] - values[:, worst, None]
            self.steps[kind, step] = upper, lower
        return self.steps[kind, step]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, before: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """vec_ids and scores of each query's best k of this block and ``before``, ties to the smaller vec_id, without its own rows."""
        most = 2 * queries.shape[1] * self.largest * max(abs(int(queries.min())), abs(int(queries.max())))
        kind = object if any(y.dtype == object for _, y in before) else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        values, queries = self.values, queries.astype(kind)
        pull = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1).T
        best = np.concatenate((values[:, -1], values[:, 0])).astype(kind) @ pull
        known = np.array([len(x) == k for x, _ in before], bool)
        bar = np.array([y[-1] if full else _lowest(kind) for (_, y), full in zip(before, known)], kind)
        # a query whose bar is out of reach doesn't read the block
        asked = np.flatnonzero(~known | (best >= bar).astype(bool))
        result = list(before)
        if not len(asked):
            return result
        pull, bar, known = np.ascontiguousarray(pull[:, asked]), bar[asked], known[asked]
        alive = self.ids[:, None] != own[asked][None, :]
        upper = np.broadcast_to(best[asked], alive.shape).copy()
        fresh = np.flatnonzero(~known)
        lower = None
        if len(fresh):
            worst = np.concatenate((values[:, 0], values[:, -1])).astype(kind) @ pull[:, fresh]
            lower = np.broadcast_to(worst, (len(self.ids), len(fresh))).copy()
        step = 0
        while step < len(DEPTHS):
            gain, sure = self.read(kind, step)
            upper += gain @ pull
            if lower is not None:
                lower += sure @ pull[:, fresh]
                if len(self.ids) >= k:
                    seen = np.where(alive[:, fresh], lower, _lowest(kind))
                    bar[fresh] = np.maximum(bar[fresh], np.partition(seen, len(seen) - k, axis=0)[-k] if kind is not object else np.sort(seen, axis=0)[-k])
            alive &= (upper >= bar).astype(bool)
            step += 1
            if np.count_nonzero(alive) <= FEW * alive.size:
                break
        for place, q in enumerate(asked.tolist()):
            rows = np.flatnonzero(alive[:, place])
            sums, mine = upper[rows, place], pull[:, place]
            for later in range(step, len(DEPTHS)):
                if not len(rows):
                    break
                gain, _ = self.read(kind, later)
                sums = sums + gain[rows] @ mine
                stay = (sums >= bar[place]).astype(bool)
                rows, sums = rows[stay], sums[stay]
            if len(rows):
                result[q] = merge(before[q], (self.ids[rows], sums if kind is object else sums.astype(np.int64)), k)
        return result


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of two rankings, ties to the smaller vec_id."""
    ids, scores = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64) if scores.dtype == object else np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def beyond(score: int) -> bytes | None:
    """Bytes in the order of scores that a long can't tell apart; None for others."""
    if -_LONG < score < _LONG - 1:
        return None
    size = abs(score).bit_length() // 8 + 1
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score > 0 else bytes(255 - b for b in raw)


def integers(vectors: pa.Array) -> list[np.ndarray | None]:
    """floor(64 * x) / 64 of each vector that takes part, which doubles hold at any size; None for others."""
    found: list[np.ndarray | None] = []
    for v in vectors:
        if not v.is_valid or not len(v.values) or v.values.null_count:
            found.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        # from 2**52 on every double is whole
        found.append(np.where(np.abs(x) < 2.0**52, np.floor(np.where(np.abs(x) < 2.0**52, x, 0.0) * SCALE) / SCALE, x) if np.isfinite(x).all() else None)
    return found


def whole(x: np.ndarray) -> np.ndarray:
    """64 * x of such doubles: 64-bit integers, or Python's where those are too narrow."""
    if np.abs(x).max(initial=0) < 2.0**55:
        return (x * SCALE).astype(np.int64)
    return np.array([int(v) * SCALE if abs(v) >= 2.0**52 else int(v * SCALE) for v in x.ravel()], object).reshape(x.shape)


def _store(x: np.ndarray) -> bytes:
    if np.abs(x).max(initial=0) < 2.0**25:
        values = (x * SCALE).astype(np.int64)
        return values.astype("<i2" if np.abs(values).max(initial=0) < 1 << 15 else "<i4").tobytes()
    return x.astype("<f8").tobytes()


def _load(raw: pa.Scalar, shape: tuple[int, int]) -> np.ndarray:
    buffer = raw.as_buffer()
    width = buffer.size // (shape[0] * shape[1])
    found = np.frombuffer(buffer, "<f8" if width == 8 else f"<i{width}").reshape(shape)
    return whole(found) if width == 8 else found.astype(np.int64)


def _pack(components: int, queries: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            values, lists = np.stack(rows), b""
            if not queries:
                order = np.argsort(values, axis=0, kind="stable").T
                values, lists = np.take_along_axis(values.T, order, axis=1), order.astype("<u4").tobytes()
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int64()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "lists": pa.array([lists], pa.binary()), "vectors": pa.array([_store(values)], pa.binary())})

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), integers(batch.column(1))):
                if v is None or vec_id is None or (queries and vec_id % EVERY):
                    continue
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                rows.append(v)
                if len(ids) * len(v) >= components:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return each


def _search(k: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []  # (number, vec_ids, vectors, rankings) of each query block

        def rankings() -> Iterator[pa.RecordBatch]:
            for q, own, _, found in asked:
                sizes = [len(x) for x, _ in found]
                scores = [s for _, y in found for s in y.tolist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "q": pa.array([q] * sum(sizes), pa.int64()),
                        "place": pa.array(np.repeat(np.arange(len(own)), sizes), pa.int32()),
                        "query_id": pa.array(np.repeat(own, sizes), pa.int64()),
                        "vec_id": pa.array([i for x, _ in found for i in x.tolist()], pa.int64()),
                        "score": pa.array([min(max(s, -_LONG), _LONG - 1) for s in scores], pa.int64()),
                        "beyond": pa.array(map(beyond, scores), pa.binary()),
                    }
                )

        for batch in batches:
            for task, kind, dim, number, raw_ids, order, vectors in zip(*(batch.column(i) for i in range(7))):
                if task.as_py() != now:
                    yield from rankings()
                    now, asked = task.as_py(), []
                ids, dim = np.frombuffer(raw_ids.as_buffer(), "<i8").copy(), dim.as_py()
                if kind.as_py() == 0:  # a task's query blocks come first
                    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    asked.append((number.as_py(), ids, _load(vectors, (len(ids), dim)), [none] * len(ids)))
                    continue
                if not asked:
                    continue
                lists = Lists(ids, np.frombuffer(order.as_buffer(), "<u4").astype(np.int64).reshape(dim, -1), _load(vectors, (dim, len(ids))))
                # a group's first block begins with small ones, which give a bar
                cuts = [0, 4 * k, 32 * k, len(ids)] if not any(len(x) for _, _, _, found in asked for x, _ in found) else [0, len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < (b := min(b, len(ids))):
                        some = lists if b - a == len(ids) else lists.part(a, b)
                        asked = [(q, own, v, some.search(v, own, k, found)) for q, own, v, found in asked]
        yield from rankings()

    return each


def exact_top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the best k of all rows for each query row."""
    spark = vectors.sparkSession
    rows = only(vectors, "vec_id", "embedding")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("embedding"), F.lit(0)).cast("long")).alias("x")).first()
    kinds = "dim int, part long, ids binary, lists binary, vectors binary"
    n_blocks = max(1, -(-(size["x"] or 0) // BLOCK))
    n_asked = max(1, -(-(size["x"] or 0) // (QUERIES * EVERY)))
    blocks, _ = stage(rows.repartition(n_blocks).mapInArrow(_pack(BLOCK, False), kinds), "candidate-blocks")
    asked = rows.filter(F.col("vec_id") % EVERY == 0).repartition(n_asked)
    queries, _ = stage(asked.mapInArrow(_pack(QUERIES, True), kinds), "query-blocks")
    # each task holds up to GROUP query blocks; there are tasks for all cores where blocks allow it
    cores = max(spark.sparkContext.defaultParallelism, partitions(spark))
    c_groups = min(n_blocks, max(-(-n_blocks // (4 * GROUP)), int((2 * cores) ** 0.5)))
    q_groups = min(n_asked, max(-(-n_asked // GROUP), -(-2 * cores // c_groups)))
    mine, theirs = F.pmod("part", F.lit(q_groups)), F.pmod("part", F.lit(c_groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.monotonically_increasing_id()
    asks = queries.withColumn("number", number).withColumn("i", mine).withColumn("j", every(c_groups)).withColumn("kind", F.lit(0))
    gives = blocks.withColumn("number", number).withColumn("j", theirs).withColumn("i", every(q_groups)).withColumn("kind", F.lit(1))
    task = (F.col("dim").cast("long") * q_groups + F.col("i")) * c_groups + F.col("j")
    columns = ["task", "kind", "dim", "number", "ids", "lists", "vectors"]
    both = asks.withColumn("task", task).select(columns).unionByName(gives.withColumn("task", task).select(columns))
    dealt = both.repartitionByRange(max(1, q_groups * c_groups), "task").sortWithinPartitions("task", "kind", "number")
    found = dealt.mapInArrow(_search(k), "q long, place int, query_id long, vec_id long, score long, beyond binary")
    order = Window.partitionBy("q", "place").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""
