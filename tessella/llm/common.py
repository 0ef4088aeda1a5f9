"""Shared plumbing: the shared folder, staged tables and small Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 of a null text.
EMPTY = b""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a session of one
    machine gets a temporary folder, remembered in the session; on a cluster, whose
    executors would write to disks of their own, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("tessella.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.shared.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None, few: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    With ``few`` it is written by at most two tasks a core, where shuffle partitions are
    many and rows of a few bytes would lie in as many files.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    if few:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no remaining plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that Python no longer holds."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that clashing extra columns can't interfere."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null gives no bytes."""
    return [EMPTY if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
