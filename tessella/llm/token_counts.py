"""Token counts with a digest cache.

A cache row is (tokenizer, digest, n_bytes, n_tokens): the SHA-256 of the tokenizer
file and library version, the SHA-256 of the normalised content, and its counts.
Documents meet the cache by both digests; only distinct contents that it lacks are
encoded, once each, and appended. Counts then come from the cache alone.

Normalised content: null is the empty text. If the tokenizer has a normaliser, it is
the normaliser's output, except for texts that hold an added token's string, which
stand for themselves, as added tokens are found before normalising. Copies collapse
in each map task before the texts are shuffled, so a text that a third of all rows
share moves once a task; the last join reads stored tables on both sides, so adaptive
execution can split the rows of one digest. Repeated rows each get their row, rows
without doc_id too; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, only, stage

#: Bytes of text that one call of the library gets.
CALL_BYTES = 1 << 20
_CACHE = "tokenizer string, digest string, n_bytes long, n_tokens long"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The library's tokenizer for ``path``, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def _normaliser(path: str):
    return None if path.endswith(".model") else load_tokenizer(path).normalizer


def count_texts(texts: list[str], path: str) -> list[int]:
    tokenizer = load_tokenizer(path)
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _digests(path: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            forms = [b"raw\0" + t.encode() if any(a in t for a in added) else tokenizer.normalizer.normalize_str(t).encode() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashlib.sha256(x).hexdigest() for x in forms], pa.string())], names=[*batch.schema.names, "digest"])

    return each


def _encode(path: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            group: list[str] = []
            size = 0
            for text in batch.column("text"):
                group.append(text.as_py())
                size += len(group[-1])
                if size >= CALL_BYTES:
                    counts += count_texts(group, path)
                    group, size = [], 0
            counts += count_texts(group, path) if group else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["digest", "n_bytes", "n_tokens"])

    return each


def token_counts(docs: DataFrame, path: str, cache_path: str | None = None, limit: int = 1024) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), counted through the cache at ``cache_path``.

    Without a path the cache is a new one in the shared folder.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    cache_path = cache_path or fresh_path(spark, "token-cache")
    texts = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    keyed = texts.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256)) if _normaliser(path) is None else texts.mapInArrow(_digests(path), "doc_id long, text string, digest string")
    # a new cache is an empty table, so documents meet it in any case
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(_CACHE).parquet(cache_path)
    own = F.col("tokenizer") == version
    contents = keyed.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    misses = contents.join(stored.filter(own).select("digest"), "digest", "left_anti")
    encoded = misses.mapInArrow(_encode(path), "digest string, n_bytes long, n_tokens long")
    encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache_path)
    # two jobs may have appended the same content; their counts are equal
    wanted = spark.read.schema(_CACHE).parquet(cache_path).filter(own).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts, _ = stage(wanted, "token-counts")
    found = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
