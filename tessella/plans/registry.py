"""Registration of queries, and helpers that they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Make a query known under ``name``, with SQL for its rows where SQL can say it."""

    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; results are rounded."""
    return df.select([(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
