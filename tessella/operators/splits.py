"""Cross-validation: fold numbers as window expressions over an explicit order."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.frame import ONE_TASK_ROWS, exact_quantile, in_order, numeric_columns


def _seeded(order: Sequence[str], seed: int | None):
    return [F.xxhash64(*order, F.lit(seed)), *order] if seed is not None else list(order)


def kfold(df: DataFrame, k: int, order: Sequence[str], name: str = "fold", seed: int | None = None, limit: int = ONE_TASK_ROWS) -> DataFrame:
    """Contiguous blocks; the first n mod k have one row more. With a seed the order is hashed."""
    n, i = df.count(), F.col("__i")
    long, size = n % k, n // k
    if n > limit and seed is None and len(order) == 1 and order[0] in numeric_columns(df):
        # blocks of one number need only the numbers between them, if those part the rows as they should
        x = F.col(order[0]).cast("double")
        starts = [j * size + min(j, long) for j in range(1, k)]
        cuts = [exact_quantile(df, x, (b - 0.5) / (n - 1)) for b in starts]
        if list(df.agg(*[F.count_if(x > c) for c in cuts], F.count_if(x.isNull() | F.isnan(x))).first()) == [*[n - b for b in starts], 0]:
            return df.withColumn(name, sum(((x > c).cast("int") for c in cuts), F.lit(0)))
    fold = F.when(i < long * (size + 1), F.floor(i / (size + 1))).otherwise(long + F.floor((i - long * (size + 1)) / max(size, 1)))
    return in_order(df, _seeded(order, seed)).withColumn(name, fold.cast("int")).drop("__i")


def repeated_kfold(df: DataFrame, k: int, repeats: int, order: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows once a repeat, with columns repeat and fold."""
    return _union(kfold(df, k, order, seed=seed + r).withColumn("repeat", F.lit(r)) for r in range(repeats))


def within_class(df: DataFrame, label: str, order: Sequence, place: str = "__i", size: str = "__n") -> DataFrame:
    """Each row's place from 0 in its class and the class's size; no window holds a class beyond the bound of in_order."""
    sizes = df.groupBy(F.col(label).alias("__c")).agg(F.count("*").alias(size))
    before = F.sum(size).over(Window.orderBy(F.col("__c").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__c", size, F.coalesce(before, F.lit(0)).alias("__a"))
    numbered = in_order(df, [F.col(label).asc_nulls_first(), *order], place)
    placed = numbered.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__c")))  # one row a class
    return placed.withColumn(place, F.col(place) - F.col("__a")).drop("__c", "__a")


def stratified_kfold(df: DataFrame, k: int, label: str, order: Sequence[str], name: str = "fold", seed: int | None = None) -> DataFrame:
    """Round-robin within each class."""
    return within_class(df, label, _seeded(order, seed)).withColumn(name, (F.col("__i") % k).cast("int")).drop("__i", "__n")


def repeated_stratified_kfold(df: DataFrame, k: int, repeats: int, label: str, order: Sequence[str], seed: int = 0) -> DataFrame:
    return _union(stratified_kfold(df, k, label, order, seed=seed + r).withColumn("repeat", F.lit(r)) for r in range(repeats))


def train_test_split(df: DataFrame, test_size: float, order: Sequence[str], stratify: str | None = None, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; with ``stratify`` every class gives ceil(n * test_size) rows to the test part.

    Test rows are the first of the order, or of a hashed order with a seed.
    """
    label = F.col(f"`{stratify}`") if stratify else F.lit(0)
    placed = within_class(df.withColumn("__l", label), "__l", _seeded(order, seed))
    test = F.col("__i") < F.ceil(F.col("__n") * test_size - 1e-9)
    return placed.filter(~test).select(*df.columns), placed.filter(test).select(*df.columns)


def _union(frames) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _greedy(groups: list[tuple], k: int) -> dict:
    """Groups in order, each to the fold with fewest rows, the first on ties."""
    size = [0] * k
    found = {}
    for group, n in groups:
        fold = min(range(k), key=lambda f: (size[f], f))
        found[group] = fold
        size[fold] += n
    return found


def group_kfold(df: DataFrame, k: int, group: str, name: str = "fold") -> DataFrame:
    """Groups by size, then by number, to the smallest fold.

    The assignment is greedy, so one row a group goes to the driver.
    """
    sizes = df.groupBy(group).count().orderBy(F.desc("count"), group).collect()
    return _assigned(df, group, _greedy([(r[0], r[1]) for r in sizes], k), name)


def stratified_group_kfold(df: DataFrame, k: int, group: str, label: str, name: str = "fold") -> DataFrame:
    """Groups by dominant class (ties to the smaller), each class's groups by size to the smallest fold."""
    counts = df.groupBy(group, label).count()
    per = counts.groupBy(group).agg(F.sum("count").alias("n"), F.max_by(label, F.struct("count", -F.col(label))).alias("main")).orderBy("main", F.desc("n"), group).collect()
    return _assigned(df, group, _greedy([(r[0], r["n"]) for r in per], k), name)


def _assigned(df: DataFrame, group: str, found: dict, name: str) -> DataFrame:
    schema = f"__g {df.schema[group].dataType.simpleString()}, {name} int"
    return df.join(df.sparkSession.createDataFrame(list(found.items()), schema), F.col(group) == F.col("__g")).drop("__g")


def time_series_split(df: DataFrame, splits: int, order: Sequence[str], test_size: int | None = None, gap: int = 0, max_train: int | None = None) -> DataFrame:
    """Rows (split, part) with part train or test; training ends ``gap`` rows before the test."""
    n = df.count()
    size = test_size or n // (splits + 1)
    indexed = in_order(df, order)
    parts = []
    for s in range(splits):
        start = n - (splits - s) * size
        end = max(start - gap, 0)
        begin = max(end - max_train, 0) if max_train else 0
        parts += [F.struct(F.lit(s).alias("split"), F.lit(begin).alias("a"), F.lit(end).alias("b"), F.lit("train").alias("part")), F.struct(F.lit(s).alias("split"), F.lit(start).alias("a"), F.lit(start + size).alias("b"), F.lit("test").alias("part"))]
    out = indexed.select("*", F.explode(F.array(*parts)).alias("__s")).filter("__i >= __s.a AND __i < __s.b")
    return out.select(*df.columns, "__s.split", "__s.part")


def leave_one_out(df: DataFrame, order: Sequence[str], max_rows: int = 10_000) -> DataFrame:
    """Each row with the number of the split that tests it."""
    if df.count() > max_rows:
        raise ValueError("too many rows to leave each out")
    return df.withColumn("split", F.row_number().over(Window.orderBy(*order)) - 1)


def leave_p_out(n: int, p: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(n), p))


def shuffle_split(df: DataFrame, splits: int, order: Sequence[str], test_size: float = 0.1, seed: int = 0) -> DataFrame:
    """Rows (split, part): the first of each split's hashed order are its test part."""
    n = df.count()
    cut = int(-(-n * test_size // 1))
    return _union(
        in_order(df, _seeded(order, seed + s)).withColumn("split", F.lit(s)).withColumn("part", F.when(F.col("__i") < cut, "test").otherwise("train")).drop("__i") for s in range(splits)
    )
