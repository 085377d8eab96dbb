"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every document becomes eleven transformed statistics of its whole text, none of them its length;
counts are smoothed, so that few words are weak evidence.  Class means and
covariances come from sums of x and x x' over *all* labelled training rows, added up on the
cluster (a fixed number of sums reaches the driver).  Covariances shrink towards their
diagonal, their Cholesky factors are inverted once, and a score is the logistic of the
difference of the two Mahalanobis log densities plus the log prior odds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

FEATURES = (
    "lower", "upper", "digit", "symbol", "shout", "punctuation", "non_ascii", "log_word_bytes",
    "distinct_words", "commonest_word", "repeated_lines",
)
K = len(FEATURES)
_CLASS = np.full(256, 7, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 shout, 5 punctuation, 6 white, 7 other
_CLASS[:128] = 5
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!")):
    _CLASS[list(_chars)] = _k
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
#: Smoothing: this many bytes in these shares of the first seven features, and this many words.
PRIOR_BYTES, PRIOR_WORDS = 60, 30
PRIOR_SHARE = np.array([0.9, 0.03, 0.005, 0.005, 0.005, 0.035, 0.02])


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of a UTF-8 text; shares enter as square roots, sizes as logs.
    A null, empty or blank text has
    the prior statistics alone."""
    text = text or b""
    words = text.split()
    n = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8)
    ink = len(text) - n[6]
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    share = np.sqrt((n[[0, 1, 2, 3, 4, 5, 7]] + PRIOR_BYTES * PRIOR_SHARE) / (ink + PRIOR_BYTES))
    weigh = len(words) + PRIOR_WORDS
    return np.array([
        *share, np.log((ink + 5 * PRIOR_WORDS) / weigh),
        np.sqrt((len(seen) + 0.8 * PRIOR_WORDS) / weigh), np.sqrt((max(seen.values(), default=0) + 0.05 * PRIOR_WORDS) / weigh),
        np.sqrt((len(lines) - len(set(lines)) + 0.1) / (len(lines) + 5)),
    ])


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every row."""

    def run(batches):
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            flat = np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * K, pa.int32()), pa.array(flat))], names=["id", "x"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): log prior, mean, inverse Cholesky factor, log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = [self.prior[c] - 0.5 * (self.logdet[c] + (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1)) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(z[0] - z[1], -700, 700)))


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 1e-4) -> Discriminant:
    """Fit to (x, y) rows.  A class without rows takes the pooled moments and prior 1 / (n + 2)."""

    def moments(batches):
        n, s, o = np.zeros(2), np.zeros((2, K)), np.zeros((2, K, K))
        for b in batches:
            x, y = np.array(b.column(0).flatten()).reshape(-1, K), b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                p = x[y == c]
                n[c] += len(p)
                s[c] += p.sum(axis=0)
                o[c] += p.T @ p
        flat = np.concatenate([np.concatenate([[n[c]], s[c], o[c].ravel()]) for c in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    size = 1 + K + K * K
    flat = np.zeros(2 * size)
    for r in rows.select("x", "y").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r.i] = r.v
    n, s, o = flat.reshape(2, size)[:, 0], flat.reshape(2, size)[:, 1 : 1 + K], flat.reshape(2, size)[:, 1 + K :].reshape(2, K, K)
    total = max(n.sum(), 1.0)
    mean_all = s.sum(axis=0) / total
    pooled = o.sum(axis=0) / total - np.outer(mean_all, mean_all)
    mean = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], mean_all)
    inverse, logdet = [], []
    for c in (0, 1):
        cov = o[c] / n[c] - np.outer(mean[c], mean[c]) if n[c] else pooled
        alpha = max(shrink, min(1.0, K / max(n[c], 1)))
        cov = (1 - alpha) * cov + alpha * np.diag(np.diag(cov)) + ridge * np.eye(K)
        low = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(np.log((n + 1) / (total + 2)), mean, np.array(inverse), np.array(logdet))


def quality_classifier(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    ``held_out`` is a condition on the id; held-out labels are never read.  Labels without a
    document, null labels and null ids train nothing.  Null and empty texts get a score like
    any other; without any labels all scores are one half.  Repeated rows score alike, extra
    columns are ignored and an empty table gives no rows.
    """
    got = materialize(features(docs, id_col, text_col).withColumnRenamed("id", id_col), "quality-features")
    known = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("long").alias("y")).filter(F.col("y").isin(0, 1)).filter(~held_out)
    model = fit(got.join(known, id_col))

    def run(batches):
        for b in batches:
            x = np.array(b.column(2).flatten()).reshape(-1, K)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"]
            )

    return got.select(id_col, held_out.alias("held_out"), "x").mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int")
