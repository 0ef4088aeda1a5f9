"""The named queries over the driver's tables and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.preprocessing import StandardScaler
from tessella.plans import iterations, models, statistics, tables, workflow  # noqa: F401  they register their queries
from tessella.plans.registry import QUERIES, SQL, Query, rounded, table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled line items: scan, fit by one aggregate, transform, then moments and share of each class."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scaled = StandardScaler().fit_transform(table(spark, sf_dir, "lineitem").select(*columns, "l_returnflag"), columns)
    found = scaled.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("var", F.var_pop))])
    return rounded(found.orderBy("l_returnflag"), [c for c in found.columns if c not in ("l_returnflag", "n")])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
