"""Results that must be whole: distances of rows that share nothing, documents of unknown words, stratified parts, absent libraries."""

import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from tessella.errors import InvalidInput
from tessella.operators.bayes import TermNB
from tessella.operators.compose import TextPipeline
from tessella.operators.neighbors import random_over_sample, random_under_sample
from tessella.operators.search import meta_features
from tessella.operators.splits import train_test_split, within_class
from tessella.operators.text import CountVectorizer, SparseMatrix, TfidfTransformer

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_distances_of_rows_that_share_no_column(spark):
    rows = {0: {0: 1.0, 1: -2.0}, 1: {2: 3.0}, 3: {0: 1.0, 2: -1.0}}  # row 2 has no value
    table = spark.createDataFrame([(r, c, v) for r, own in rows.items() for c, v in own.items()], "row long, column long, value double")
    m = SparseMatrix(table, 4, 3)
    dense = [[rows.get(r, {}).get(c, 0.0) for c in range(3)] for r in range(4)]
    for metric, size in (("euclidean", lambda d: math.sqrt(sum(x * x for x in d))), ("manhattan", lambda d: sum(map(abs, d)))):
        got = {(r["query"], r["row"]): r["distance"] for r in m.distances(m, metric).collect()}
        assert set(got) == {(i, j) for i in range(4) for j in range(4)}
        assert all(math.isclose(got[i, j], size([a - b for a, b in zip(dense[i], dense[j])]), abs_tol=1e-9) for i, j in got)
    with pytest.raises(InvalidInput):
        m.distances(m, "hamming")


@pytest.mark.parametrize("kind", ["multinomial", "bernoulli"])
def test_documents_of_unknown_words_get_the_prior(spark, kind):
    terms = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "b", 1)], "doc long, term string, n long")
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc long, y string")
    new = spark.createDataFrame([(10, "b", 3), (11, "zzz", 1)], "doc long, term string, n long")
    docs = spark.createDataFrame([(10,), (11,), (12,)], "doc long")
    got = {r["doc"]: r["prediction"] for r in TermNB(kind).fit(terms, labels).predict(new, docs).collect()}
    assert got[10] == "y" and set(got) == {10, 11, 12}
    assert kind == "bernoulli" or got[11] == got[12] == "x"


def test_text_pipeline(spark):
    docs = spark.createDataFrame([(1, "red green red", "c"), (2, "green blue", "c"), (3, "cat dog", "a"), (4, "dog cow", "a")], "doc_id long, text string, kind string")
    new = spark.createDataFrame([(5, "blue red"), (6, "cow cat"), (7, ""), (8, None)], "doc_id long, text string")
    for weights in (None, TfidfTransformer()):
        got = {r["doc"]: r["prediction"] for r in TextPipeline(CountVectorizer(), TermNB(), weights).fit(docs, "kind").predict(new).collect()}
        assert got[5] == "c" and got[6] == "a" and set(got) == {5, 6, 7, 8}


def test_stratified_parts(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 7, 2)] if i % 11 else None) for i in range(200)], "id long, y string")
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    for seed in (None, 3):
        train, test = train_test_split(df, 0.3, ["id"], "y", seed)
        assert train.columns == df.columns and {r["id"] for r in train.collect()}.isdisjoint({r["id"] for r in test.collect()})
        assert {r["y"]: r["count"] for r in test.groupBy("y").count().collect()} == {c: math.ceil(n * 0.3 - 1e-9) for c, n in sizes.items()}
        assert train.count() + test.count() == 200
    places = within_class(df, "y", ["id"]).groupBy("y").agg(F.max("__i").alias("most"), F.count_distinct("__i").alias("n"), F.max("__n").alias("size")).collect()
    assert all(r["most"] + 1 == r["n"] == r["size"] == sizes[r["y"]] for r in places)


def test_samplers_reach_their_counts(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(103)], "id long, y int")
    under = random_under_sample(df, "y")
    assert under.columns == df.columns and {r["y"]: r["count"] for r in under.groupBy("y").count().collect()} == {0: 21, 1: 21}
    over = random_over_sample(df, "y")
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {0: 82, 1: 82} and over.select("id").distinct().count() == 103


def test_every_class_counts_in_a_profile(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("y"))
    found = meta_features(df, ["x"], "y")
    assert found["classes"] == 4901 and math.isclose(found["majority"], 0.02) and math.isclose(found["minority"], 1 / 5000)
    assert math.isclose(found["entropy"], -(0.02 * math.log(0.02)) + 4900 / 5000 * math.log(5000), rel_tol=1e-9)


@pytest.mark.parametrize("absent", ["tessella.llm", "xxhash", "tokenizers", "corpus_pipeline"])
def test_the_entry_survives_what_only_the_subpackage_needs(absent):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {absent!r} or name.startswith({absent!r} + '.'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'standard_scaler_lineitem' in e.queries() and 'kmeans' in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT})
