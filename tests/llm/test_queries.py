"""The ten queries on the driver's smallest tables, and the folder that they share."""

import os

import pytest
from pyspark.sql import functions as F
from tessella.llm import common, queries, simhash

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_rans": "doc_id start n_tokens ids_crc32",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_digest_cache": "doc_id n_bytes n_tokens over_limit",
    "op4_repetition": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_no_random_access": "query_id rank vec_id score",
    "op6_merged_bwt": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_style_tree": "page_id url text n_chars",
    "op9_fair_queueing": "doc_id size source_size target taken",
    "op10_simhash": "doc_id fingerprint component_id",
}

here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@here
@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    table = "embeddings" if "op5" in name else "pages" if "op8" in name else "documents"
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert df.count() == (n // 20 * 20 if "op5" in name else n)


@here
def test_fingerprints_in_hexadecimal(spark):
    rows = queries.op10_simhash(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), "doc_id").filter("doc_id < 40").collect()
    assert all(r.fingerprint == f"{simhash.fingerprint(r.text):016x}" for r in rows) and rows


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Elsewhere)
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/") and F
