"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three lower-cased characters are hashed into DIM features; their document frequencies come from every
training row. Weights, the bias among them, are fitted by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties on a sample of at most TRAIN_ROWS training rows a language, a part of which is set aside for the temperature
that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, fold_of, only, prepare, uniform

DIM = 1 << 14
#: Rows of each language that the weights are fitted on at most; document frequencies take all rows.
TRAIN_ROWS = 700
#: So many times as many are drawn by hash before the least hashes are kept.
_DRAWN = 4
EPOCHS, ALPHA, BETA, L1, L2, BATCH = 4, 0.5, 1.0, 0.02, 0.02, 16
#: Value of the feature that every text has.
BIAS = 0.1
FOLD, HELD = 4, 2
SEED = 11
UNKNOWN = "und"
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and counts of a whole text's n-grams; digits and marks count as spaces, and runs of spaces as they are."""
    counts = np.zeros(DIM, np.int64)
    step = CHUNK_BYTES // 4
    for at in range(0, max(len(text), 1), step):  # grams that cross a chunk overlap by two characters
        _count(text[at : at + step + 2], counts, 0 if at + step >= len(text) else 2)
    found = np.flatnonzero(counts)
    return found, counts[found]


_KIND = np.array([ord(c) if c.isalpha() else 32 for c in map(chr, range(0x250))], np.uint64)


def _count(text: str, counts: np.ndarray, extra: int) -> None:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return
    c = np.where(c < 0x250, _KIND[np.minimum(c, 0x24F)], c).astype(np.uint64)
    h = c * _MULTIPLY[0]
    counts += np.bincount((h[: len(h) - extra] >> np.uint64(50)).astype(np.int64), minlength=DIM)
    for n in (1, 2):
        if len(c) <= n:
            break
        h = (h[:-1] ^ (c[n:] * _MULTIPLY[n])) * _MULTIPLY[0]
        stop = len(h) - max(0, extra - n)
        counts += np.bincount((h[:stop] >> np.uint64(50)).astype(np.int64), minlength=DIM)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(text) -> rows that hold each feature, and the number of rows: over every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                df[gram_counts(x or "")[0]] += 1
                n += 1
        if n:
            k = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[k, -1], pa.int32()), pa.array(np.r_[df[k], n], pa.int64())], ["k", "n"])

    df, n = np.zeros(DIM, np.int64), 0
    for r in texts.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows at most
        if r["k"] < 0:
            n = r["n"]
        else:
            df[r["k"]] = r["n"]
    return df, n


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and L2-normalised (1 + log tf) * idf of a text, and the bias as the last feature."""
    k, n = gram_counts(text)
    v = (1 + np.log(n)) * idf[k]
    return np.append(k, DIM), np.append(v / max(float(np.sqrt(v @ v)), 1e-12), BIAS)


class Ftrl:
    """Multinomial logistic regression fitted by FTRL-proximal; the weights with small |z| are exactly zero."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
        self.temperature = 1.0

    def weights(self, k: np.ndarray | slice) -> np.ndarray:
        z = self.z[k]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[k])) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = SEED) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                k, v = rows[i]
                w = self.weights(k)
                p = softmax(v @ w)
                p[y[i]] -= 1
                g = v[:, None] * p
                sigma = (np.sqrt(self.n[k] + g * g) - np.sqrt(self.n[k])) / ALPHA
                self.z[k] += g - sigma * w
                self.n[k] += g * g
        return self

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Ftrl:
        """The temperature with the least log loss on rows that the weights have not seen."""
        if len(rows):
            w = self.weights(slice(None))
            logits = np.stack([v @ w[k] for k, v in rows])
            grid = np.geomspace(0.05, 20, 61)
            loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def identify_languages(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Documents (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score: one row for each document.

    Learns only from text and lang of rows with a lang whose crc32(doc_id as text) mod 4 is not 2; ids that repeat or are
    null are no obstacle, as rows are drawn one by one. `score` is the
    calibrated probability of lang_pred. Texts that are null or without a letter give `und` with score 0; so does every
    text if there is nothing to learn from, and with one language all others get it with score 1. A null doc_id trains
    and is scored like another. An empty table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = only(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    train = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), FOLD) != HELD))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(counts)
    scored = rows.select("doc_id", "text")
    if not langs:
        model = idf = None
    else:
        df, n = document_frequencies(train)
        idf = np.log((1.0 + n) / (1.0 + df)) + 1
        share = F.create_map(*[x for c in langs for x in (F.lit(c), F.lit(min(1.0, _DRAWN * train_rows / counts[c])))])
        # Drawn by a hash of the row; rows that repeat in full are drawn once, and the least hashes of each language stay.
        drawn = train.withColumn("u", uniform(F.col("doc_id"), F.col("text"), F.lit(SEED))).where(F.col("u") < share[F.col("lang")])
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
        sample = drawn.dropDuplicates(["lang", "u"]).withColumn("rank", rank).where(F.col("rank") <= train_rows).select("doc_id", "text", "lang")

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [vector(x, idf) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([k.astype("<u2").tobytes() for k, _ in found], pa.binary()),
                     pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["doc_id", "lang", "k", "v"])

        got = sample.mapInArrow(gather, "doc_id long, lang string, k binary, v binary").toPandas()  # at most train_rows a language
        got = got.sort_values(["doc_id", "lang", "k"], kind="stable", na_position="first")
        vectors = [(np.frombuffer(k, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for k, v in zip(got["k"], got["v"])]
        y = got["lang"].map({c: i for i, c in enumerate(langs)}).to_numpy(np.int64)
        aside = np.arange(len(y)) % 5 == 4
        pick = lambda m: [v for v, x in zip(vectors, m) if x]
        fitted = Ftrl(len(langs)).fit(pick(~aside), y[~aside]).calibrate(pick(aside), y[aside])
        model = (fitted.weights(slice(None)).astype(np.float64), fitted.temperature)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            for x in b.column(1).to_pylist():
                if model is None or not has_letter(x):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                k, v = vector(x, idf)
                p = softmax(v @ model[0][k] / model[1])
                best = int(p.argmax())
                names.append(langs[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return scored.mapInArrow(predict, "doc_id long, lang_pred string, score double").select(
        "doc_id", (fold_of(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "lang_pred", "score"
    )
