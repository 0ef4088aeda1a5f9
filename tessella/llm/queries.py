"""The thin queries over the driver's tables: each derives its digest columns from an operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import bpe_round_trip
from tessella.llm.common import tokenizer_path
from tessella.llm.mixing import MIX_SQL, mix_sources
from tessella.llm.repeats import repeated_passages
from tessella.llm.repetition import RULES_SQL, repetition_rules
from tessella.llm.simhash import simhash_components
from tessella.llm.style_tree import extract_text
from tessella.llm.token_counts import token_counts
from tessella.llm.token_files import token_files
from tessella.llm.topk import TOP_K_SQL, exact_top_k
from tessella.llm.toxicity import toxicity_scores, train

#: The vocabulary of the queries; operators take its path as a parameter.
VOCABULARY = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, _table(spark, sf_dir, "labels")))


def op3_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op5_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op6_merged_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op9_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_rans, op2_toxicity, op3_digest_cache, op4_repetition, op5_no_random_access, op6_merged_bwt, op7_bpe, op8_style_tree, op9_fair_queueing, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op4_repetition": RULES_SQL, "op5_no_random_access": TOP_K_SQL, "op9_fair_queueing": MIX_SQL}
