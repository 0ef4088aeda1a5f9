"""Tables from files, by format or by extension, and generated ones."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.frame import Dataset


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    header: bool = True
    skip_rows: int = 0
    n_rows: int | None = None
    columns: tuple[str, ...] | None = None
    null_values: tuple[str, ...] = ()
    encoding: str = "UTF-8"


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions(), schema: str | None = None) -> DataFrame:
    """A CSV table; the schema is inferred unless given. ``skip_rows`` leaves out leading lines."""
    reader = spark.read.option("sep", options.delimiter).option("header", options.header).option("encoding", options.encoding)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if options.skip_rows:
        lines = spark.read.text(path)
        kept = lines.rdd.map(lambda r: r.value).zipWithIndex().filter(lambda x: x[1] >= options.skip_rows).keys()
        df = reader.csv(kept)
    else:
        df = reader.csv(path)
    if options.null_values:
        df = df.select([F.when(~F.col(f"`{c}`").cast("string").isin(*options.null_values), F.col(f"`{c}`")).alias(c) for c in df.columns])
    if options.columns:
        df = df.select(*options.columns)
    return df.limit(options.n_rows) if options.n_rows is not None else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension: csv, tsv (tabs), txt, parquet, pq, json, orc."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "txt"):
        return read_csv(spark, path)
    if kind == "tsv":
        return read_csv(spark, path, CsvOptions(delimiter="\t"))
    if kind in ("parquet", "pq"):
        return read_parquet(spark, path)
    if kind in ("json", "orc"):
        return spark.read.format(kind).load(path)
    raise InvalidInput(f"no reader for .{kind}")


def load_dataset(spark: SparkSession, path: str, target: str | None = None) -> Dataset:
    return Dataset.of(read_file(spark, path), target)


def _uniform(seed: int, *salt) -> F.Column:
    """A number in (0, 1) that depends on the row's id and the salt alone."""
    return (F.pmod(F.xxhash64("id", *[F.lit(s) for s in (seed, *salt)]), F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))


def _normal(seed: int, *salt) -> F.Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, *salt, "r"))) * F.cos(2 * math.pi * _uniform(seed, *salt, "a"))


def make_regression(spark: SparkSession, n: int, features: int, informative: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """A random linear model: columns id, x0.., y."""
    import random

    rng = random.Random(seed)
    weights = [rng.uniform(10, 100) if j < informative else 0.0 for j in range(features)]
    df = spark.range(n).select("id", *[_normal(seed, j).alias(f"x{j}") for j in range(features)])
    signal = sum((F.col(f"x{j}") * w for j, w in enumerate(weights) if w), F.lit(0.0))
    return df.withColumn("y", signal + noise * _normal(seed, "noise"))


def make_classification(spark: SparkSession, n: int, features: int, informative: int, classes: int = 2, seed: int = 0, separation: float = 2.0) -> DataFrame:
    """Gaussian classes around random corners: columns id, x0.., y."""
    import random

    rng = random.Random(seed)
    centres = [[rng.choice((-separation, separation)) if j < informative else 0.0 for j in range(features)] for _ in range(classes)]
    y = (F.col("id") % classes).cast("int")
    shift = [F.element_at(F.array(*[F.lit(c[j]) for c in centres]), y + 1) for j in range(features)]
    return spark.range(n).select("id", *[(s + _normal(seed, j)).alias(f"x{j}") for j, s in enumerate(shift)], y.cast("long").alias("y"))


def make_blobs(spark: SparkSession, n: int, features: int = 2, centers: int = 3, std: float = 1.0, seed: int = 0) -> DataFrame:
    import random

    rng = random.Random(seed)
    centres = [[rng.uniform(-10, 10) for _ in range(features)] for _ in range(centers)]
    y = (F.col("id") % centers).cast("int")
    return spark.range(n).select("id", *[(F.element_at(F.array(*[F.lit(c[j]) for c in centres]), y + 1) + std * _normal(seed, j)).alias(f"x{j}") for j in range(features)], y.cast("long").alias("y"))


def make_moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Two interleaved half circles."""
    half = max(n // 2, 1)
    upper = F.col("id") < half
    angle = math.pi * F.when(upper, F.col("id") / max(half - 1, 1)).otherwise((F.col("id") - half) / max(n - half - 1, 1))
    x0 = F.when(upper, F.cos(angle)).otherwise(1 - F.cos(angle))
    x1 = F.when(upper, F.sin(angle)).otherwise(0.5 - F.sin(angle))
    return spark.range(n).select("id", (x0 + noise * _normal(seed, 0)).alias("x0"), (x1 + noise * _normal(seed, 1)).alias("x1"), F.when(upper, 0).otherwise(1).cast("long").alias("y"))


def make_circles(spark: SparkSession, n: int, noise: float = 0.0, factor: float = 0.5, seed: int = 0) -> DataFrame:
    half = max(n // 2, 1)
    outer = F.col("id") < half
    angle = 2 * math.pi * F.when(outer, F.col("id") / half).otherwise((F.col("id") - half) / max(n - half, 1))
    radius = F.when(outer, 1.0).otherwise(factor)
    return spark.range(n).select("id", (radius * F.cos(angle) + noise * _normal(seed, 0)).alias("x0"), (radius * F.sin(angle) + noise * _normal(seed, 1)).alias("x1"), F.when(outer, 0).otherwise(1).cast("long").alias("y"))
