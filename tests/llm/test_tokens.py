"""Token counts, BPE and token files against the library."""

import hashlib
import zlib

import numpy as np
import pytest
from tessella.llm import bpe, token_counts, token_files


def ids_of(documents, vocabulary):
    tokenizer = token_counts.load_tokenizer(vocabulary)
    rows = documents.collect()
    return [(r.doc_id, r.text or "", tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in rows], tokenizer


def test_counts_match_the_library(documents, clashing, vocabulary):
    want = sorted((d, len(t.encode()), len(i), len(i) > 1024) for d, t, i in ids_of(documents, vocabulary)[0])
    assert sorted(map(tuple, token_counts.token_counts(documents, vocabulary).collect())) == want
    assert sorted(map(tuple, token_counts.token_counts(clashing, vocabulary).collect())) == want


def test_cache_encodes_only_misses(spark, documents, vocabulary, tmp_path):
    path = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_counts.token_counts(documents.filter("doc_id < 6"), vocabulary, path).collect()))
    n = spark.read.parquet(path).count()
    assert n == len({d for d in documents.filter("doc_id < 6").select("text").distinct().fillna("").distinct().collect()})
    everything = token_counts.token_counts(documents, vocabulary, path).collect()
    assert {tuple(r) for r in everything} >= set(first)
    assert spark.read.parquet(path).count() == spark.read.parquet(path).select("digest").distinct().count()


def test_normalised_content_and_other_libraries(spark, documents):
    from tessella.llm.common import tokenizer_path

    words = tokenizer_path("word_bpe_49k.json")
    tokenizer = token_counts.load_tokenizer(words)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents, words).collect()}
    assert all(got[r.doc_id] == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in documents.collect())
    pieces = tokenizer_path("piece_bpe_32k.model")
    model = token_counts.load_tokenizer(pieces)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents, pieces).collect()}
    assert all(got[r.doc_id] == len(model.encode(r.text or "")) for r in documents.collect())


def test_bpe_round_trip(documents, clashing, vocabulary):
    rows, tokenizer = ids_of(documents, vocabulary)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((d, len(i), sha(",".join(map(str, i))), sha(tokenizer.decode(i, skip_special_tokens=False))) for d, _, i in rows)
    assert sorted(map(tuple, bpe.bpe_round_trip(documents, vocabulary).collect())) == want
    assert sorted(map(tuple, bpe.bpe_round_trip(clashing, vocabulary).collect())) == want
    encoded = bpe.bpe_encode(documents, vocabulary)
    assert sorted((r.doc_id, r.ids) for r in encoded.collect()) == sorted((d, i) for d, _, i in rows)
    assert sorted(map(tuple, bpe.bpe_decode(encoded, vocabulary).collect())) == sorted((d, t) for d, t, _ in rows)


def test_stale_entries_are_skipped(vocabulary):
    pairs = bpe.byte_pairs(vocabulary)
    tokenizer = token_counts.load_tokenizer(vocabulary)
    for text in ("aaaaaaaaaaaaaaaaa", "abababababcababab", " the" * 30, "ththththethththe", "x" * 3000, "=" * 777):
        assert pairs.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, documents, clashing, vocabulary, tmp_path):
    rows, _ = ids_of(documents, vocabulary)
    rows.sort(key=lambda r: r[0])
    want, start = [], 0
    for d, _, i in rows:
        ids = np.array([*i, token_files.END], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for table, name in ((documents, "a"), (clashing, "b")):
        path = f"file://{tmp_path}/{name}"
        got = sorted(map(tuple, token_files.token_files(table, vocabulary, path).collect()))
        assert got == sorted(want)
        assert sorted((r.doc_id, r.ids) for r in token_files.read_token_files(spark, path).collect()) == sorted((d, [*i, token_files.END]) for d, _, i in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 4096, 300_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int64)
    used, counts = np.unique(np.concatenate((ids, [7])), return_counts=True)
    table = token_files.Table(used, counts)
    assert table.frequency.sum() == 1 << token_files.BITS
    payload = token_files.encode_block(ids, table)
    assert (token_files.decode_block(payload, table) == ids).all()
    step = token_files.CHECKPOINT * token_files.LANES
    for k in range(max(0, -(-n // step) - 1)) if n >= 64 * token_files.LANES else ():
        assert (token_files.decode_block(payload, table, k) == ids[(k + 1) * step : (k + 2) * step]).all()
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_block(bytes(broken), table)


def test_empty_tables(no_documents, vocabulary):
    assert token_counts.token_counts(no_documents, vocabulary).count() == 0
    assert bpe.bpe_round_trip(no_documents, vocabulary).count() == 0
    assert token_files.token_files(no_documents, vocabulary).count() == 0


def test_pretokens_match_the_pattern():
    import random

    rng = random.Random(1)
    letters = [chr(c) for c in range(0x530)] + list("日本語😀  ")
    for _ in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.4 else " \t\n's'llve12a") for _ in range(20))
        assert bpe.pretokens(text) == bpe._EVERYWHERE(text)
        assert "".join(bpe.pretokens(text)) == text
