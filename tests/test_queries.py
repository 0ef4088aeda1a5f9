"""Every query with SQL gives DuckDB's rows; every other one runs."""

import math
import os

import duckdb
import pytest
from tessella.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return found


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: float(v) if type(v).__name__ == "Decimal" else None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["h_statistic", "automl"])
def test_takes_the_whole_table(spark, name, monkeypatch):
    from tessella.plans import models

    rows = []

    def seen(df):
        rows.append(df.count())
        raise InterruptedError

    monkeypatch.setattr(models.X, "h_statistic", lambda predict, df, *a: seen(df))
    monkeypatch.setattr(models.H.AutoML, "fit", lambda self, df, *a: seen(df))
    with pytest.raises(InterruptedError):
        catalogue.queries()[name](spark, DATA)
    assert rows == [spark.read.parquet(f"{DATA}/lineitem.parquet").count()]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
