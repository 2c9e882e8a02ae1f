"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character n-grams (within the text, spaces included) each have a learned vector; a document is the
average of its features' vectors, and a softmax layer gives the two classes, trained by plain numpy stochastic
gradient descent. A pair's hash is the difference of its words' hashes, so all immediate repetitions share a vector.
For scoring, vectors times output weights collapse to one number per bucket, and a document needs one gather.

Learned from the labelled ids whose fold is not held out, at most about `fit_rows` of them by a hash of doc_id, one text of each; of a text
beyond `fit_chars` characters pieces from its beginning to its end are learned, and `FIT_FEATURES` features of each text are drawn by a seeded
generator in every epoch. Every whole text is scored. A null or empty text has no features and gets the classes' prior; a null label is
ignored; a doc_id labelled twice counts as good if any label says so; a score at the threshold is good; repeated rows score alike;
other columns are ignored, whatever their names; an empty table gives no rows; without labels of both kinds every score is the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc32, map_batches, rows_of, table
from .toxicity import labelled

BUCKETS, DIM, NGRAMS, FIT_ROWS, FIT_CHARS, FIT_FEATURES, EPOCHS, RATE, THRESHOLD = 1 << 17, 8, (2, 3, 4), 6_000, 16_000, 1024, 6, 0.5, 0.5
_K, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _K
    return ((h ^ (h >> np.uint64(32))) * _P >> np.uint64(47)).astype(np.int32)  # 17 bits


def features(text: str | None) -> np.ndarray:
    """Buckets of all features of a text: character n-grams, words, pairs."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(raw):
        return np.zeros(0, np.int32)
    out, h = [], raw + np.uint64(1)
    for k in range(2, max(NGRAMS) + 1):
        if len(raw) < k:
            break
        h = h[:-1] * _K + raw[k - 1 :] + np.uint64(1)
        if k in NGRAMS:
            out.append(_bucket(h, k))
    space = (raw <= 32) | (raw == 160)
    edge = np.diff(np.concatenate(([1], space, [1])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start):
        mixed = raw * _K
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _P
        # a word's hash: its mixed characters weighted by their place in it
        place = np.arange(len(raw), dtype=np.uint64) - np.repeat(start, np.diff(np.concatenate((start, [len(raw)])))).astype(np.uint64) if start[0] == 0 else None
        if place is None:
            place = np.arange(len(raw), dtype=np.uint64) - np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.concatenate((start, [len(raw)])))))).astype(np.uint64)
        power = mixed * (place * np.uint64(2) + np.uint64(1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(power, dtype=np.uint64)))
        word = total[end] - total[start]
        out += [_bucket(word, 11), _bucket(word[1:] - word[:-1], 12)]
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class Quality:
    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.bias + (float(self.weight[f].mean()) if len(f) else 0.0) for f in map(features, texts)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], good: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 9) -> Quality:
    n, ones = len(good), sum(good)
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if not ones or ones == n:
        return Quality(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, 2)), np.array([0.0, prior])
    docs = [features(t) for t in texts]
    y = np.eye(2)[np.array(good)]
    for epoch in range(epochs):
        for step, i in enumerate(rng.permutation(n)):
            f = docs[i]
            if not len(f):
                continue
            lr = rate * (1 - (epoch * n + step) / (epochs * n))
            if len(f) > FIT_FEATURES:
                f = f[rng.integers(0, len(f), FIT_FEATURES)]
            own, count = np.unique(f, return_counts=True)
            share = (count / len(f))[:, None]
            rows = e[own]
            mean = (rows * share).sum(0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            g = y[i] - p / p.sum()
            back = out @ g
            out += lr * np.outer(mean, g)
            bias += 0.1 * lr * g
            e[own] = rows + lr * len(own) ** 0.5 * share * back
    collapsed = e @ (out[:, 1] - out[:, 0])
    return Quality(collapsed.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Quality:
    return train(*labelled(docs, labels, "quality", 3, 1, fit_rows, fit_chars))


def score_quality(docs: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each bucket

    def make():
        own = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            score = own.score(rows_of(batch, "text"))
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32)}

        return run

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc32() % 3 == 1).alias("held_out"), "text")
    return map_batches(base, make, "doc_id long, held_out boolean, score double, predicted int")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
