"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its own diagonal and the pooled covariance; the score is the
logistic of the difference of the two Gaussian log densities (Mahalanobis distances by cached Cholesky factors) plus the
log prior odds, tempered. Class sums are taken over all labelled rows by a distributed aggregate; only they reach the
driver, (1 + d + d * d) numbers a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of, keep_texts, only, prepare, text_chunks, trimmed, words

SHRINK = 0.15
POOL = 0.10
TEMPERATURE = 4.0
THRESHOLD = 0.7
FOLD, HELD = 4, 2

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [0x20, *range(0x09, 0x0E)],
    "line": [10], "stop": [ord(c) for c in ".,"], "bar": [ord("|")], "mark": [ord(c) for c in "#$%&*!@^~<>{}[]=+_\\"],
    "high": range(128, 256),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _codes in enumerate(_CLASSES.values()):
    _TABLE[list(_codes), _k] = 1
FEATURES = ("chars", "words", "length", "spread", "upper", "digit", "line", "stop", "bar", "mark", "high", "repeat", "adjacent", "entropy")
D = len(FEATURES)


def statistics(column: pa.Array) -> np.ndarray:
    """(n, D) transformed statistics of whole texts; all zero-count ratios are taken as 0, so empty texts have a row too."""
    out = [_statistics(t) for t in text_chunks(column)]
    return np.concatenate(out) if out else np.zeros((0, D))


def _statistics(t) -> np.ndarray:
    size = np.diff(t.start)
    which = np.repeat(np.arange(t.n), size)
    hist = np.bincount(which * 256 + t.data, minlength=256 * t.n).reshape(t.n, 256)
    c = dict(zip(_CLASSES, (hist @ _TABLE).T))
    h, a, b, doc = words(t)
    n = np.bincount(doc, minlength=t.n)
    some, length = np.maximum(n, 1), (b - a).astype(float)
    mean = np.bincount(doc, length, t.n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, t.n) / some - mean * mean, 0))
    same = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=t.n) if len(h) > 1 else np.zeros(t.n)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    repeated = np.bincount(ds[1:][(hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])], minlength=t.n) if len(h) > 1 else np.zeros(t.n)
    total = np.maximum(size, 1)
    p = hist / total[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    letters = c["lower"] + c["upper"] + 50  # short texts say little: their ratios shrink towards 0
    return np.stack([
        np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), root(c["upper"] / letters), root(c["digit"] / (total + 100)),
        root(c["line"] / (total + 100)), root(c["stop"] / (n + 20)), root(c["bar"] / (n + 20)), root(c["mark"] / (n + 20)), root(c["high"] / total),
        root(repeated / (n + 20)), root(same / (n + 20)), entropy,
    ], 1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "x"])

    prepare(docs.sparkSession)
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(trimmed(run), "doc_id long, x array<double>")


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(x, label, weight) -> class -> (n, sum, sum of outer products)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + D + D * D))
        for b in batches:
            x = np.array(b.column(0).flatten()).reshape(-1, D)
            label, w = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(float)
            for k in (0, 1):
                y, v = x[label == k], w[label == k]
                sums[k] += np.concatenate([[v.sum()], v @ y, ((y * v[:, None]).T @ y).ravel()])
        k, i = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(sums.ravel())], ["k", "i", "v"])

    out = np.zeros((2, 1 + D + D * D))
    for r in rows.select("x", "label", "weight").mapInArrow(trimmed(run), "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out[r["k"], r["i"]] = r["v"]
    return {k: (out[k, 0], out[k, 1 : 1 + D], out[k, 1 + D :].reshape(D, D)) for k in (0, 1)}


class Discriminant:
    """Two shrunk Gaussians; `score` is the tempered posterior of class 1. With a class missing, the other is certain;
    without any label the score is 0.5."""

    def __init__(self, sums: dict, shrink: float = SHRINK, pool: float = POOL, temperature: float = TEMPERATURE):
        n = {k: sums[k][0] for k in (0, 1)}
        self.known, self.temperature = [k for k in (0, 1) if n[k] > 0], temperature
        self.parts = {}
        if len(self.known) < 2:
            return
        cov = {}
        for k in (0, 1):
            m = sums[k][1] / n[k]
            cov[k] = (m, sums[k][2] / n[k] - np.outer(m, m))
        pooled = (n[0] * cov[0][1] + n[1] * cov[1][1]) / (n[0] + n[1])
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 0) + 1e-6)  # a constant statistic has no weight
        for k in (0, 1):
            m, c = cov[k]
            c = (1 - pool) * c + pool * pooled
            c = c / np.outer(self.scale, self.scale)
            c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + 1e-2 * np.eye(D)
            root = np.linalg.cholesky(c)
            # cached: inverse factor and log density constant
            self.parts[k] = (m, np.linalg.inv(root), -np.log(np.diag(root)).sum())
        self.prior = np.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.known) < 2:
            return np.full(len(x), float(self.known[0]) if self.known else 0.5)
        g = {}
        for k, (m, inverse, constant) in self.parts.items():
            z = ((x - m) / self.scale) @ inverse.T
            g[k] = constant - 0.5 * (z * z).sum(1)
        return 1 / (1 + np.exp(np.clip((g[0] - g[1]) / self.temperature - self.prior, -500, 500)))


def fit(feats: DataFrame, labels: DataFrame) -> Discriminant:
    """Statistics (doc_id, x) and labels -> the discriminant of the rows whose crc32(doc_id as text) mod 4 is not 2."""
    y = only(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(fold_of(F.col("doc_id"), FOLD) != HELD)
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).agg(F.count("*").alias("weight"))
    return Discriminant(class_sums(feats.join(y, "doc_id")))


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and labels (doc_id, quality 0/1) -> doc_id, held_out, score, predicted: one row for each document.

    Learns only from rows whose crc32(doc_id as text) mod 4 is not 2. Null and empty texts have statistics of zeros and
    are scored like others. Null labels, and labels other than 0 and 1, teach nothing; a label row that repeats counts
    again. A null doc_id matches no label. Empty tables give an empty result or, without labels, scores of 0.5.
    """
    feats = cut(features(docs))
    model = fit(feats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten()).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return feats.mapInArrow(trimmed(run), "doc_id long, score double").select(
        "doc_id", (fold_of(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject (score of at least THRESHOLD), with all their columns.

    Every row is judged by its own text, whatever its doc_id: null and repeated ids are like others. Null and empty
    texts are judged by their statistics of zeros."""
    prepare(docs.sparkSession)
    learn = only(docs, "doc_id", "text").where(fold_of(F.col("doc_id").cast("long"), FOLD) != HELD)
    model = fit(features(learn), labels)
    return keep_texts(docs, lambda text: model.score(statistics(text)) >= THRESHOLD)
