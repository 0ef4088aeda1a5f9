"""Quality rules: how much of a text lies in repeated n-grams and lines.

A word is a maximal run of bytes outside space and ``\\t..\\r``. Each word gets its
number within the document, and the numbers are rolled into 64-bit polynomial
hashes of n words in numpy: the hash of n words is the hash of the first n-1,
times a fixed odd multiplier, plus the next word's mixed number. An n-gram is
duplicated when its hash occurs twice or more in the document. Its characters are
then marked at all of its occurrences, the first included, so overlaps count once.

Short n-grams recur in any long text, so those of fewer than four words count only where
they stand right after themselves: a run is an n-gram of up to RUN words that equals the
n words before it. Limits of longer n-grams lie below what the base rule lets pass.

Null and empty texts have no words, fail the base rule and are not kept.
Repeated rows are judged alike, each by itself: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import only

#: Share of a text's word characters that may lie in duplicated n-grams, by n.
NGRAM_LIMITS = {4: 0.30, 5: 0.30, 6: 0.28, 8: 0.27, 10: 0.25, 13: 0.22}
#: Share of word characters that may lie in lines equal to an earlier line, and in runs of up to RUN words.
LINE_LIMIT, RUN_LIMIT, RUN = 0.45, 0.20, 5
MIN_WORDS, BASE_NGRAM, BASE_PERCENT = 20, 8, 30
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\f\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_chars", pa.int64()), ("run_chars", pa.int64())]
    + [(f"dup_chars_{n}", pa.int64()) for n in NGRAM_LIMITS]
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_starts(hashes: np.ndarray) -> np.ndarray:
    """Where a value stands that the array holds twice or more."""
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return np.flatnonzero(twice[at] == hashes)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in the n-word windows that begin at ``starts``."""
    edge = np.zeros(size + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return np.cumsum(edge[:-1]) > 0


def back_to_back(ids: np.ndarray, n: int) -> np.ndarray:
    """Where n words begin that equal the n words before them."""
    if len(ids) < 2 * n:
        return np.zeros(0, np.int64)
    equal = np.concatenate(([0], np.cumsum(ids[n:] == ids[:-n])))
    return np.flatnonzero(equal[n:] - equal[:-n] == n) + n


def measure(text: str | None) -> tuple:
    """The row of one text, without its id."""
    text = text or ""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            chars = len(line) - sum(map(line.count, BLANKS))
            n_dup_lines += chars > 0
            dup_line_chars += chars
        else:
            seen.add(line)
    n_repeat, run_chars, dup_chars = 0, 0, dict.fromkeys(NGRAM_LIMITS, 0)
    if n_words > 1:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n_words)
        lengths = np.fromiter((len(w.decode()) for w in number), np.int64, len(number))[ids.astype(np.int64)]
        runs = [(back_to_back(ids, n), n) for n in range(1, RUN + 1)]
        inside = np.zeros(n_words, bool)
        for starts, n in runs:
            if len(starts):
                inside |= covered(starts, n, n_words)
        run_chars = int(lengths[inside].sum())
        values = _mix(ids + np.uint64(1))
        rolled = values.copy()
        for n in range(2, max(NGRAM_LIMITS) + 1):
            if n > n_words:
                break
            rolled = rolled[:-1] * _MULTIPLIER + values[n - 1 :]
            if n not in NGRAM_LIMITS and n != BASE_NGRAM:
                continue
            starts = repeated_starts(rolled)
            if not len(starts):
                break  # a longer window repeats only where its beginning does
            inside = covered(starts, n, n_words)
            if n == BASE_NGRAM:
                n_repeat = int(inside.sum())
            if n in NGRAM_LIMITS:
                dup_chars[n] = int(lengths[inside].sum())
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > BASE_PERCENT * n_words
    kept = not base_failed and dup_line_chars <= LINE_LIMIT * word_chars and run_chars <= RUN_LIMIT * word_chars and all(dup_chars[n] <= most * word_chars for n, most in NGRAM_LIMITS.items())
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, dup_line_chars, run_chars, *dup_chars.values())


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column(1)]
        columns = list(zip(*rows)) if rows else [()] * (len(_SCHEMA) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:]))], schema=_SCHEMA)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its repetition figures and the verdict ``kept``."""
    kinds = {pa.int64(): "long", pa.bool_(): "boolean"}
    return only(docs, "doc_id", "text").mapInArrow(_judge, ", ".join(f"{f.name} {kinds[f.type]}" for f in _SCHEMA))


def _keep(at: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([measure(x)[6] for x in texts], pa.bool_()))

    return each


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return docs.mapInArrow(_keep(docs.columns.index("text")), docs.schema)


def _window_sql(n: int) -> str:
    return f"""a{n} AS (SELECT r, i, w, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS k FROM words),
b{n} AS (SELECT r, i, w, len(k) = {n} AND count(*) OVER (PARTITION BY r, k) > 1 AS twice FROM a{n}),
c{n} AS (SELECT r, w, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM b{n}),
d{n} AS (SELECT r, sum(inside)::BIGINT AS n, sum(inside * length(w))::BIGINT AS chars FROM c{n} GROUP BY r)"""


_RUNS = range(1, RUN + 1)
_RUN_SQL = f"""same AS (SELECT r, i, w, {", ".join(f"coalesce(w = lag(w, {n}) OVER o, false)::INT AS q{n}" for n in _RUNS)} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
begun AS (SELECT r, i, w, {", ".join(f"(sum(q{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) = {n})::INT AS s{n}" for n in _RUNS)} FROM same),
within AS (SELECT r, w, greatest({", ".join(f"max(s{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _RUNS)}) AS inside FROM begun),
runs AS (SELECT r, sum(inside * length(w))::BIGINT AS chars FROM within GROUP BY r)"""

RULES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
counts AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY r),
lines AS (SELECT r, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM (SELECT r, string_split(text, chr(10)) AS ls FROM docs)),
dup AS (SELECT r, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT r, l, row_number() OVER (PARTITION BY r, l ORDER BY i) AS k FROM lines) WHERE k > 1),
dups AS (SELECT r, count(*) FILTER (chars > 0) AS n, sum(chars)::BIGINT AS chars FROM dup GROUP BY r),
{", ".join(map(_window_sql, sorted({*NGRAM_LIMITS, BASE_NGRAM})))},
{_RUN_SQL},
rows AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
         coalesce(d{BASE_NGRAM}.n, 0) AS n_repeat_words, coalesce(dups.chars, 0) AS dup_line_chars, coalesce(runs.chars, 0) AS run_chars,
         {", ".join(f"coalesce(d{n}.chars, 0) AS dup_chars_{n}" for n in NGRAM_LIMITS)}
  FROM docs LEFT JOIN counts USING (r) LEFT JOIN dups USING (r) LEFT JOIN runs USING (r) {" ".join(f"LEFT JOIN d{n} USING (r)" for n in sorted({*NGRAM_LIMITS, BASE_NGRAM}))}
), judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM rows)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND dup_line_chars <= {LINE_LIMIT}::DOUBLE * word_chars AND run_chars <= {RUN_LIMIT}::DOUBLE * word_chars AND {" AND ".join(f"dup_chars_{n} <= {most}::DOUBLE * word_chars" for n, most in NGRAM_LIMITS.items())} AS kept,
       dup_line_chars, run_chars, {", ".join(f"dup_chars_{n}" for n in NGRAM_LIMITS)}
FROM judged
"""
