"""Statistics of streams: batches' sums merge into a state table, so batch and stream agree.

Moments keep n, mean and centred sums of squares by key and column; merging two states
is exact algebra. Each micro-batch writes a new version of the state, and the version
number makes a replayed batch harmless.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.frame import clean


def moments(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by.., n, mean, m2) of a column."""
    x = clean(column)
    return df.filter(x.isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merge_moments(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """The moments of both tables' rows together."""
    both = a.unionByName(b)
    n = F.sum("n")
    total = F.sum(F.col("n") * F.col("mean"))
    mean = total / n
    # sums about the joint mean: m2 + n (mean - joint)^2
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") ** 2) - total * total / n
    return both.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("m2"))


def variance(state: DataFrame, ddof: int = 1) -> DataFrame:
    return state.withColumn("variance", F.when(F.col("n") > ddof, F.col("m2") / (F.col("n") - ddof)))


class MomentSink:
    """A state folder for foreachBatch: version v holds the merge of batches 0 .. v - 1."""

    def __init__(self, spark: SparkSession, path: str, column: str, by: Sequence[str]):
        self.spark, self.path, self.column, self.by = spark, path.rstrip("/"), column, list(by)

    def _exists(self, version: int) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self._exists(batch_id + 1):
            return  # a replay of a batch that is in the state
        own = moments(batch, self.column, self.by)
        if self._exists(batch_id):
            own = merge_moments(self.read(batch_id), own, self.by)
        own.write.mode("overwrite").parquet(f"{self.path}/v{batch_id + 1}")
        self.last = batch_id + 1

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version if version is not None else self.last}")


def stream_moments(stream: DataFrame, sink: MomentSink, checkpoint: str) -> StreamingQuery:
    """Run what is available of a stream into the sink."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums of value by event-time window, for batches and, with a watermark, streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    found = rows.groupBy(F.window(time, size, slide), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), *by, "n", "total")


def drift(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: population stability index on the reference's quantile bins, and the shift of means in deviations."""
    edges = reference.agg(F.percentile(clean(column), F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0]
    at = F.array(*[F.lit(float(e)) for e in edges])
    number = F.aggregate(at, F.lit(0), lambda n, e: n + (e <= clean(column)).cast("int"))
    both = reference.select(number.alias("b"), F.lit(1).alias("r"), clean(column).alias("x")).unionByName(current.select(number.alias("b"), F.lit(0).alias("r"), clean(column).alias("x")))
    per = both.groupBy("b").agg(F.sum("r").alias("p"), F.sum(1 - F.col("r")).alias("q"), F.sum(F.when(F.col("r") == 1, F.col("x"))).alias("sp"), F.sum(F.when(F.col("r") == 0, F.col("x"))).alias("sq"), F.sum(F.when(F.col("r") == 1, F.col("x") ** 2)).alias("s2"))
    t = per.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.sum("sp").alias("mp"), F.sum("sq").alias("mq"), F.sum("s2").alias("s2"))
    joined = per.select("p", "q").join(F.broadcast(t), F.lit(True))  # one row of totals
    a, b = F.greatest(F.col("p") / F.col("tp"), F.lit(1e-6)), F.greatest(F.col("q") / F.col("tq"), F.lit(1e-6))
    mean = F.col("mp") / F.col("tp")
    shift = (F.col("mq") / F.col("tq") - mean) / F.sqrt(F.col("s2") / F.col("tp") - mean**2)
    return joined.agg(F.sum((a - b) * F.ln(a / b)).alias("psi"), F.max(shift).alias("mean_shift"))
