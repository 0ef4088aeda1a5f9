"""A corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, token ids.

Each stage reads what its predecessor kept, as Parquet; all but the last return the
columns of ``documents``, the last the token ids with digests of ids and decoded text.
Mixing may take a document twice, and BPE then encodes both. The other operators of
tessella.llm (toxicity, extraction, token counts, token files, top-k) take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.bpe import bpe_round_trip
from tessella.llm.common import stage, tokenizer_path
from tessella.llm.mixing import mixed_documents
from tessella.llm.queries import VOCABULARY
from tessella.llm.repeats import without_repeats
from tessella.llm.repetition import keep_documents
from tessella.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, tokenizer_path(VOCABULARY), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("token ids", token_ids),
]

#: SQL has neither the fingerprints' components nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs, _ = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
