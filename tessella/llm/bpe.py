"""Byte-level BPE by a priority queue of merge ranks, and its decoding.

The symbols of a pretoken form a doubly linked list. The queue holds the rank and
the position of every adjacent pair that can merge; the least rank wins, then the
leftmost. A merge leaves entries behind that no longer describe their position; they
are recognised by their rank and skipped. Decoding concatenates vocabulary strings.

Pretokens repeat, so each worker remembers their ids, in decimal, in two bounded generations.
Null texts are empty and have no ids. Strings of added tokens inside a text are
those tokens. Rows are independent: repeated rows and very long texts need nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm.common import only

#: The byte-level split of texts into pretokens (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens that one generation of a worker's memory holds, and the longest of them.
MEMORY, LONGEST = 500_000, 64
_PLACE = 1 << 32
_EVERYWHERE = regex.compile(PATTERN).findall
#: White space below U+3000 (fixed values of Unicode).
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f"


def _characters(category: str) -> str:
    """A character class of the Unicode category's characters below U+3000."""
    own = [c for c in range(0x3000) if unicodedata.category(chr(c))[0] == category]
    first = [c for c, before in zip(own, [-2, *own]) if c != before + 1]
    last = [c for c, after in zip(own, [*own[1:], -1]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


_LETTERS, _NUMBERS = _characters("L"), _characters("N")
#: The same split for Latin, Greek, Cyrillic and punctuation, in classes that the faster engine knows.
_BELOW = re.compile(f" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+").findall
_ABOVE = re.compile("[^\x00-\u052f\u2000-\u206f]").search


def pretokens(text: str) -> list[str]:
    """The pretokens of a text, which joined are the text."""
    return _BELOW(text) if text.isascii() or not _ABOVE(text) else _EVERYWHERE(text)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if visible, else from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class BytePairs:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        vocabulary = model["vocab"]
        stands = byte_characters()
        self.first = [vocabulary[stands[b]] for b in range(256)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocabulary[a + b] for a, b in pairs]
        byte = {c: b for b, c in stands.items()}
        self.strings = {i: bytes(byte[c] for c in token) for token, i in vocabulary.items()}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens that take in white space or stand between words only")
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings |= {i: content.encode() for content, i in added.items()}
        self.added = added
        self.added_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.find = pretokens
        self.by_decimal = {str(i): x for i, x in self.strings.items()}
        # strings only: the collector, which runs after every task, needn't look into them
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        symbols = [self.first[b] for b in data]
        n = len(symbols)
        ranks, merged = self.ranks, self.merged
        queue = []
        for i in range(n - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None:
                queue.append(rank * _PLACE + i)
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = divmod(heapq.heappop(queue), _PLACE)
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # stale: the pair has changed since
            new = symbols[i] = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((new, symbols[k]))
                if rank is not None:
                    heapq.heappush(queue, rank * _PLACE + i)
            h = before[i]
            if h >= 0:
                rank = ranks.get((symbols[h], new))
                if rank is not None:
                    heapq.heappush(queue, rank * _PLACE + h)
        return [s for s in symbols if s >= 0]

    def _learn(self, pretoken: str) -> str:
        found = self.old.get(pretoken)
        if found is None:
            found = ",".join(map(str, self.merge(pretoken.encode())))
        if len(pretoken) <= LONGEST:
            if len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[pretoken] = found
        return found

    def _part(self, text: str) -> list[str]:
        pretokens = self.find(text)
        found = list(map(self.young.get, pretokens))
        if None in found:
            for k, known in enumerate(found):
                if known is None:
                    found[k] = self.young.get(pretokens[k]) or self._learn(pretokens[k])
        return found

    def decimals(self, text: str) -> str:
        """The ids in decimal, with commas."""
        if self.added_split and any(a in text for a in self.added):
            found: list[str] = []
            for place, part in enumerate(self.added_split.split(text)):
                found += [str(self.added[part])] if place % 2 else self._part(part)
            return ",".join(found)
        return ",".join(self._part(text))

    def encode(self, text: str) -> list[int]:
        written = self.decimals(text)
        return list(map(int, written.split(","))) if written else []

    def decode_decimals(self, written: str) -> str:
        """The text of ids in decimal with commas."""
        return b"".join(map(self.by_decimal.__getitem__, written.split(","))).decode("utf-8", "replace") if written else ""

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, concatenated; bytes that aren't UTF-8 are replaced."""
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _round_trip(path: str, with_ids: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in batches:
            counts, ids_digests, text_digests, ids = [], [], [], []
            for value in batch.column(1):
                written = pairs.decimals(value.as_py() or "")
                counts.append(written.count(",") + 1 if written else 0)
                ids_digests.append(hashlib.sha256(written.encode()).hexdigest())
                text_digests.append(hashlib.sha256(pairs.decode_decimals(written).encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(written, np.int32, sep=",") if written else np.zeros(0, np.int32))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_digests, pa.string()), "decoded_sha256": pa.array(text_digests, pa.string())}
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(counts)))
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return each


def _encode(path: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in batches:
            ids = pa.array([pairs.encode(x.as_py() or "") for x in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return each


def _decode(path: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in batches:
            texts = pa.array([pairs.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return each


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids): the token ids of every whole text."""
    return only(docs, "doc_id", "text").mapInArrow(_encode(path), "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) of the ids of ``tokens``; null ids give the empty text."""
    return only(tokens, "doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: counts and digests of ids and of the decoded text, and the ids if asked for."""
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return only(docs, "doc_id", "text").mapInArrow(_round_trip(path, with_ids), kinds + (", ids array<int>" if with_ids else ""))
