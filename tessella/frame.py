"""Tables as data sets: features, a target, an order, and what is known of their columns.

Columns are known by name. NaN means missing and becomes NULL on entry, as Spark's
aggregates skip NULL but carry NaN on. Nothing here collects rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidInput

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def clean(column: str | Column) -> Column:
    """A double with NULL for NaN."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(x), x)


#: Rows that a window without partitions may hold; more go through ranges of the order.
ONE_TASK_ROWS = 2_000_000


def settled(df: DataFrame) -> DataFrame:
    """The table without its lineage, in the folder of spark.checkpoint.dir; only a session of one machine may leave it unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        context.setCheckpointDir(path)
    return df.checkpoint()


def in_order(df: DataFrame, order: Sequence[str | Column], index: str = "__i", sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, limit: int = ONE_TASK_ROWS) -> DataFrame:
    """The rows with their number from 0 in the given order, and running sums and maxima of expressions.

    Up to ``limit`` rows this is one window. Beyond it the table is dealt by ranges of
    the order and stored; each range is numbered by itself and a table with one row a
    range, which is what is broadcast, says where it begins.
    """
    sums, tops = sums or {}, tops or {}
    runs = [(n, F.sum, x, F.lit(0), lambda a, b: a + b) for n, x in sums.items()] + [(n, F.max, x, None, F.greatest) for n, x in tops.items()]
    if df.count() <= limit:
        w = Window.orderBy(*order)
        return df.select("*", (F.row_number().over(w) - 1).cast("long").alias(index), *[f(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for name, f, x, _, _ in runs])
    parts = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    own, part = F.col("__m").bitwiseAND((1 << 33) - 1), F.shiftright("__m", 33)
    # no name that a caller's own columns have: these are joined with them
    totals = parts.groupBy(part.alias("__p")).agg(F.count("*").alias("__before"), *[f(x).alias(f"__t_{name}") for name, f, x, _, _ in runs])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__p", F.coalesce(F.sum("__before").over(before), F.lit(0)).alias("__before"), *[f(f"__t_{name}").over(before).alias(f"__t_{name}") for name, f, _, _, _ in runs])
    within = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    found = parts.withColumn("__p", part).select("*", *[f(x).over(within).alias(name) for name, f, x, _, _ in runs]).join(F.broadcast(starts), "__p")
    joined = [join(F.coalesce(f"__t_{name}", zero) if zero is not None else F.col(f"__t_{name}"), F.col(name)).alias(name) for name, _, _, zero, join in runs]
    return found.select(*[F.col(c) for c in df.columns], (F.col("__before") + own).alias(index), *joined)


def with_previous(df: DataFrame, order: Sequence[str | Column], column: str, name: str, limit: int = ONE_TASK_ROWS) -> DataFrame:
    """The rows with a column's value in the row before: a window up to ``limit`` rows, a join by number beyond."""
    if df.count() <= limit:
        return df.withColumn(name, F.lag(column).over(Window.orderBy(*order)))
    numbered = settled(in_order(df, order, limit=limit))
    return numbered.join(numbered.select((F.col("__i") + 1).alias("__i"), F.col(column).alias(name)), "__i", "left").drop("__i")


def exact_quantile(df: DataFrame, x: Column, q: float = 0.5, few: int = 20_000) -> float | None:
    """The quantile of an expression, interpolated as percentile does, without a table of all its values.

    Counts of 4,096 bins narrow the range that holds the rank, until ``few`` rows or one
    value are left; those are counted one by one.
    """
    rows, v = df.select(x.alias("__x")).filter("__x IS NOT NULL"), F.col("__x")
    n, low, high = rows.agg(F.count("*"), F.min(v), F.max(v)).first()
    if not n:
        return None
    rank = (n - 1) * q
    wanted, below, held = (math.floor(rank), math.ceil(rank)), 0, n
    while held > few and low < high:
        width = (high - low) / 4096
        if not 0 < width < math.inf:  # infinities, or neighbours among the doubles
            break
        place = F.least(F.floor((v - low) / width), F.lit(4095)).cast("int")
        bins = rows.filter((v >= low) & (v <= high)).groupBy(place.alias("__b")).agg(F.count("*").alias("__k"), F.min(v).alias("__l"), F.max(v).alias("__h")).collect()
        upto, kept = below, []
        for b in sorted(bins, key=lambda r: r["__b"]):
            if upto <= wanted[1] and wanted[0] < upto + b["__k"]:
                kept.append((upto, b))
            upto += b["__k"]
        if len(kept) > 1:  # the rank lies between two bins
            return (wanted[1] - rank) * kept[0][1]["__h"] + (rank - wanted[0]) * kept[1][1]["__l"]
        held, below, low, high = kept[0][1]["__k"], kept[0][0], kept[0][1]["__l"], kept[0][1]["__h"]
    at = [None, None]
    for r in sorted(rows.filter((v >= low) & (v <= high)).groupBy(v).agg(F.count("*").alias("__k")).collect(), key=lambda r: r["__x"]):
        at = [r["__x"] if a is None and w < below + r["__k"] else a for a, w in zip(at, wanted)]
        below += r["__k"]
    return at[0] if at[0] == at[1] else (wanted[1] - rank) * at[0] + (rank - wanted[0]) * at[1]


@dataclass(frozen=True)
class Dataset:
    """A table with its feature columns, target and order key."""

    df: DataFrame
    features: tuple[str, ...]
    target: str | None = None
    order: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, target: str | None = None, features: Sequence[str] | None = None, order: Sequence[str] = (), nulls: str = "nan") -> Dataset:
        """The numeric columns of ``df`` as doubles; the target defaults to the last.

        ``nulls`` is "nan" (keep as missing) or "error".
        """
        numeric = numeric_columns(df)
        if not numeric:
            raise InvalidInput("the table has no numeric column")
        target = target or numeric[-1]
        if target not in numeric:
            raise InvalidInput(f"target {target} isn't a numeric column")
        features = [c for c in (features or numeric) if c != target and c in numeric]
        kept = [*order, *[c for c in [*features, target] if c not in order]]
        df = df.select([clean(c).alias(c) if c not in order else F.col(c) for c in kept])
        if nulls == "error" and not df.filter(" OR ".join(f"`{c}` IS NULL" for c in [*features, target])).isEmpty():
            raise InvalidInput("the table holds missing values")
        return cls(df, tuple(features), target, tuple(order))

    def select(self, features: Sequence[str]) -> Dataset:
        return replace(self, features=tuple(features), df=self.df.select(*dict.fromkeys([*self.order, *features, *([self.target] if self.target else [])])))

    def describe(self) -> DataFrame:
        return describe(self.df, self.features)

    def class_counts(self) -> DataFrame:
        return self.df.groupBy(F.round(self.target).cast("long").alias("class")).agg(F.count("*").alias("n"))

    def infer_task(self) -> str:
        """classification if the target is integral with few values, else regression."""
        y = F.col(self.target)
        n, unique, broken = self.df.agg(F.count(y), F.count_distinct(y), F.count_if(y != F.floor(y))).first()
        return "classification" if not broken and unique <= 20 and (n < 50 or unique < n / 5) else "regression"

    def batches(self, size: int) -> DataFrame:
        """The rows with a batch number; the last batch may be short."""
        return in_order(self.df, self.order).withColumn("batch", F.floor(F.col("__i") / size)).drop("__i")

    def train_test_split(self, test_size: float = 0.25, shuffle: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """The tail of the order, or of a hashed order, is the test part."""
        order = [F.xxhash64(*self.order, F.lit(seed)), *self.order] if shuffle else list(self.order)
        n = self.df.count()
        cut = n - int(n * test_size + 0.5)
        indexed = in_order(self.df, order)
        return indexed.filter(F.col("__i") < cut).drop("__i"), indexed.filter(F.col("__i") >= cut).drop("__i")


def stacked(df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide columns as rows (feature, value), by one pass."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), clean(c).alias(value)) for c in columns])).alias("__s")).select(f"__s.{name}", f"__s.{value}")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n, mean, std, min, max, median, n_missing."""
    x = F.col("value")
    return stacked(df, columns).groupBy("feature").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.lit(0.5)).alias("median"), F.count_if(x.isNull()).alias("n_missing")
    )


def infer_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: kind (binary, categorical, integer, continuous), bounds, uniques, missing."""
    x = F.col("value")
    finite = F.when(F.abs(x) < float("inf"), x)
    found = stacked(df, columns).groupBy("feature").agg(
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.count_distinct(finite).alias("n_unique"), F.count_if(finite != F.floor(finite)).alias("n_broken"), F.count_if(finite.isNull()).alias("n_missing")
    )
    binary = (F.col("n_unique") == 2) & (F.col("min") == 0) & (F.col("max") == 1)
    kind = F.when(binary, "binary").when((F.col("n_broken") == 0) & (F.col("n_unique") <= 20), "categorical").when(F.col("n_broken") == 0, "integer").otherwise("continuous")
    return found.select("feature", kind.alias("kind"), "min", "max", "n_unique", (F.col("n_missing") > 0).alias("allow_missing"))


@dataclass(frozen=True)
class FeatureSpec:
    """What a column may hold."""

    name: str
    kind: str = "continuous"
    allow_missing: bool = False
    low: float | None = None
    high: float | None = None
    categories: tuple[float, ...] | None = None


def validate(df: DataFrame, specs: Sequence[FeatureSpec], row_id: str, mode: str = "warn", max_issues: int | None = None) -> DataFrame:
    """Rows (row_id, feature, issue, severity) for every broken rule; mode strict raises if there are any."""
    missing = [s.name for s in specs if s.name not in df.columns]
    if missing:
        raise InvalidInput(f"columns are missing: {missing}")
    rules = []
    for s in specs:
        raw = F.col(s.name).cast("double")
        x = clean(s.name)
        found = [("missing", "error", x.isNull())] if not s.allow_missing else []
        found.append(("infinite", "error", F.abs(raw) == float("inf")))
        if s.kind in ("integer", "categorical", "binary"):
            found.append(("not_integer", "warning", x != F.floor(x)))
        if s.low is not None:
            found.append(("below_minimum", "warning", x < s.low))
        if s.high is not None:
            found.append(("above_maximum", "warning", x > s.high))
        if s.categories is not None:
            found.append(("unknown_category", "warning", ~x.isin(*s.categories)))
        rules += [F.when(broken, F.struct(F.lit(s.name).alias("feature"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for issue, severity, broken in found]
    issues = df.select(row_id, F.explode(F.array_compact(F.array(*rules))).alias("i")).select(row_id, "i.*")
    if mode == "strict" and not issues.isEmpty():
        raise InvalidInput("the table breaks its schema")
    if mode == "permissive":
        issues = issues.filter("severity = 'error'")
    return issues.limit(max_issues) if max_issues else issues


def check_finite(df: DataFrame, columns: Sequence[str], allow_missing: bool = False) -> None:
    """Raise if a column holds infinities, or missing values where those aren't allowed; an empty table too."""
    bad = [F.count_if((F.abs(F.col(c).cast("double")) == float("inf")) | (F.lit(not allow_missing) & clean(c).isNull())) for c in columns]
    n, *broken = df.agg(F.count("*"), *bad).first()
    if not n:
        raise InvalidInput("the table is empty")
    wrong = [c for c, k in zip(columns, broken) if k]
    if wrong:
        raise InvalidInput(f"not finite: {wrong}")


def drop_constant(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> list[str]:
    """The columns whose population variance is above the threshold."""
    found = df.agg(*[F.var_pop(clean(c)) for c in columns]).first()
    return [c for c, v in zip(columns, found) if v is not None and v > threshold]


def resolve_columns(df: DataFrame, selector: Sequence[int] | Sequence[bool] | Sequence[str] | str, used: Sequence[str] = ()) -> list[str]:
    """Names from indices, a mask, names, "all" or "remainder" (what ``used`` leaves)."""
    if selector == "all":
        return list(df.columns)
    if selector == "remainder":
        return [c for c in df.columns if c not in set(used)]
    chosen = list(selector)
    if chosen and all(isinstance(x, bool) for x in chosen):
        return [c for c, keep in zip(df.columns, chosen) if keep]
    return [df.columns[x] if isinstance(x, int) else x for x in chosen]
