import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    from tessella.llm.common import tokenizer_path

    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, special strings, other scripts."""
    long = "word number {} of a rather long text that goes on. "
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, again and again, until the dog wakes up.", "en", "a", 10),
        (2, "The quick brown fox jumps over the lazy dog, again and again, until the dog wakes up.", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", None, 4),
        (6, "".join(long.format(i) for i in range(3000)), "en", "a", 1),
        (7, "one", "de", "c", 3),
        (8, "a<|endoftext|>b <|endoftext|>", "en", "b", 3),
        (9, "Ünïcode — 日本語 テスト 😀\r\nsecond line\x00 end", "ja", "\U0001f600", 3),
        (10, "spam spam spam spam " * 40, "en", "a", 3),
        (11, "same line here\n" * 12, "en", "b", 3),
        (1, "The quick brown fox jumps over the lazy dog, again and again, until the dog wakes up.", "en", "a", 10),
        (12, "THE QUICK brown fox jumps over the lazy dog, again and again, until the dog wakes up.", "en", "c", 10),
        (13, "x" * 500, "en", "c", 10),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["size", "digest", "n_bytes", "n_tokens", "row", "bits", "component_id", "rank", "key", "bucket", "start", "score", "target", "pack", "first_id", "kept", "host", "removed", "n_removed", "clean", "n_spans", "__pass", "pass", "a.b", "node", "first", "key_id", "own_digest", "key_digest"]
    return documents.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
