"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and white space is made plain; every run of 3, 4 and 5
characters is hashed in numpy to one of 2**19 buckets, and a text has the set of its
buckets as features. On the training rows each bucket gets the log of its smoothed
share in toxic over its share in other texts. Logistic regression on features scaled
by those ratios gives the weights; a score is the logistic of a text's sum.

Training uses at most ``max_rows`` labelled rows, those whose doc_id has the least
hash; that bound is what may be broadcast and fitted on the driver. The model has at
most ``max_features`` buckets, the most telling by chi-square of those that ``min_docs``
training rows have: a parameter of the model, as ratios of rare n-grams are noise. Scoring covers
every whole text. Null and empty texts have no features and get the intercept's score.
Labels other than 0 and 1 and null ids teach nothing; of several labels of one doc_id
the largest counts, of several texts of one doc_id the one of least digest. Without rows of both classes all scores are the smoothed share of
toxic ones, one half without any rows. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import only, remove, stage

LENGTHS, BUCKETS = (3, 4, 5), 1 << 19
MAX_ROWS, MAX_FEATURES, MIN_DOCS = 12_000, 4_000, 4
SMOOTHING, PENALTY, STEPS = 1.0, 1e-3, 150
_BLANKS = dict.fromkeys(map(ord, "\t\n\x0b\f\r\xa0"), " ")


def features(text: str | None) -> np.ndarray:
    """The bucket of every n-gram occurrence."""
    codes = np.frombuffer((" " + (text or "").lower().translate(_BLANKS) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    found, rolled = [], codes
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in LENGTHS:
            mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found)


@dataclass
class Model:
    """Weights of the kept buckets, ratios included; column[b] is -1 for others."""

    column: np.ndarray
    weights: np.ndarray
    intercept: float

    def kept(self, text: str | None) -> np.ndarray:
        """Columns of a text's kept features, each once."""
        columns = self.column[features(text)]
        return np.unique(columns[columns >= 0])

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.kept(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def select(buckets: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Column of each bucket and log-count ratio of each column, the most telling first."""
    enough = pos + neg >= min_docs
    buckets, pos, neg = buckets[enough], pos[enough].astype(float), neg[enough].astype(float)
    ratio = np.log((pos + SMOOTHING) / (pos + SMOOTHING).sum()) - np.log((neg + SMOOTHING) / (neg + SMOOTHING).sum())
    n, df = n_pos + n_neg, pos + neg
    expected = df * n_pos / n
    telling = (pos - expected) ** 2 / np.maximum(expected * (1 - df / (n + 1)), 1e-9)
    order = np.lexsort((buckets, -telling))[:max_features]
    column = np.full(BUCKETS, -1, np.int32)
    column[buckets[order]] = np.arange(len(order))
    return column, ratio[order]


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps: weights with the ratios, intercept."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    scaled = ratio[flat]
    y = labels.astype(float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    share = float(weight @ y)
    w, b = np.zeros(len(ratio)), float(np.log(share / (1 - share)))
    norms = np.bincount(owner, scaled**2, len(rows)) + 1
    rate = 4.0 / float(np.quantile(norms, 0.99))
    w0, b0, momentum = w.copy(), b, 0.0
    for step in range(STEPS):
        momentum = step / (step + 3)
        v, c = w + momentum * (w - w0), b + momentum * (b - b0)
        z = np.bincount(owner, v[flat] * scaled, len(rows)) + c
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        w0, b0 = w, b
        w = v - rate * (np.bincount(flat, error[owner] * scaled, len(ratio)) + PENALTY * v)
        b = c - rate * float(error.sum())
    return w * ratio, b


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[toxic][np.unique(features(text.as_py()))] += 1
    used = np.flatnonzero(counts.sum(axis=0) > 0)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[1][used]), pa.array(counts[0][used])], names=["bucket", "pos", "neg"])


def _kept(model: Model):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [model.kept(x.as_py()).astype("<i4").tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1)], names=["columns", "toxic"])

    return each


def _score(model: Model):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return each


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> Model:
    """A model from the labelled rows that aren't held out."""
    spark = docs.sparkSession
    known = only(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one row for each doc_id, however often the documents repeat it
    texts = found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("least")).select("least.text", "toxic")
    rows, path = stage(texts, "toxicity-rows")
    rows = rows.repartition(8)
    n = dict(rows.groupBy("toxic").count().collect())
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        remove(spark, path)
        return Model(np.full(BUCKETS, -1, np.int32), np.zeros(0), float(np.log((n_pos + 1) / (n_neg + 1))))
    counts = rows.mapInArrow(_count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(f"pos + neg >= {min_docs}").toArrow()
    column, ratio = select(*(counts.column(c).to_numpy() for c in ("bucket", "pos", "neg")), n_pos, n_neg, max_features, min_docs)
    model = Model(column, np.zeros(len(ratio)), 0.0)
    sets = rows.mapInArrow(_kept(model), "columns binary, toxic int").toArrow()
    remove(spark, path)
    model.weights, model.intercept = fit([np.frombuffer(x.as_buffer(), "<i4") for x in sets.column("columns")], sets.column("toxic").to_numpy(), ratio)
    return model


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of all documents."""
    scored = only(docs, "doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
