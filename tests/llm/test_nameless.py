"""Rows without an id, among others and alone."""

from pyspark.sql import functions as F
from tessella.llm import bpe, mixing, repeats, repetition, style_tree, token_counts, token_files, topk, toxicity


def test_rows_without_ids(spark, documents, vocabulary):
    nameless = documents.filter("doc_id > 3").withColumn("doc_id", F.lit(None).cast("long"))
    n = nameless.count()
    for table in (nameless, nameless.unionByName(documents)):
        size = table.count()
        assert token_counts.token_counts(table, vocabulary).count() == size
        assert bpe.bpe_round_trip(table, vocabulary).count() == size
        rows = token_files.token_files(table, vocabulary).orderBy("start").collect()
        assert len(rows) == size and [r.doc_id is None for r in rows] == [True] * n + [False] * (size - n)
        assert repetition.repetition_rules(table).count() == size
        assert mixing.mix_sources(table).count() == size
        found = repeats.repeated_passages(table).collect()
        assert len(found) == size and all(r.n_removed == 0 for r in found if r.doc_id is None)
    model = toxicity.train(documents, spark.createDataFrame([(None, 1)], "doc_id long, toxic int"))
    assert toxicity.toxicity_scores(nameless, model).filter("held_out IS NULL AND score = 0.5").count() == n
    pages = spark.createDataFrame([(None, None, None), (None, "u", "<p>a</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in style_tree.extract_text(pages).collect()) == ["", "a"]
    vectors = spark.createDataFrame([(None, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(vectors).count() == 0
