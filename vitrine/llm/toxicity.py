"""Toxicity by maximum-scoring segments over token log-odds.

A token is a word or one of its stems (its first 4, 5 or 6 bytes), hashed into one of SLOTS weights; tokens that share a
slot share its weight. A weight is the log-odds of toxic against clean use under a Dirichlet prior that is worth PRIOR
uses of every token in the proportion of the classes, so an unseen token has weight 0 and rare ones little; every token
counts, whatever its weight. A position of a text scores the sum over its word and stems less COST. The Ruzzo-Tompa scan
finds all maximal scoring segments of a text in linear time.

A segment's score is calibrated by extreme-value statistics: in a text of n words, P(a chance segment reaches s) =
1 - exp(-K n exp(-lambda s)), with lambda and K fitted by maximum likelihood to the best segments of clean training
texts. Significant further segments add to the evidence, and a logistic curve over it, fitted to clean and toxic training
texts with equal weight, gives the score. For both fits a text is scored by weights that its own quarter of the training texts did not
enter; the final scores take the weights of all of them.

Uses of a token are counted once for each distinct text (in lower case), not for each copy, and apart for clean and toxic
labels: a text that has both labels is a witness of both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of, only, prepare, text_chunks, words

FOLD, HELD = 3, 1
THRESHOLD = 0.7
STEMS = (4, 5, 6)
SLOTS = 1 << 20
#: Pseudo-uses of every token; cost of a position.
PRIOR, COST = 10.0, 1.0
#: Parts of the training texts for the two fits.
QUARTERS = 4
#: A further segment counts if chance gives one as good in less than this share of clean texts.
ALPHA = 0.3
#: Lambdas that are tried, and the share of clean texts whose best segments lie below the fitted tail.
_LAMBDAS, _TAIL = np.geomspace(0.05, 8, 64), 0.5
_TILE = 1 << 16


def slots(h: np.ndarray) -> np.ndarray:
    """Slots of (positions, word and stems) hashes; SLOTS where a stem is missing."""
    return np.where(h == 0, SLOTS, h & np.uint64(SLOTS - 1)).astype(np.int32)


def log_odds(n0: np.ndarray, n1: np.ndarray, texts0: float, texts1: float) -> np.ndarray:
    """Weights of all slots, with one more of 0, from the numbers of clean and toxic texts that use each."""
    share = texts1 / (texts0 + texts1)
    odds = np.log((n1 + PRIOR * share) / (n0 + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return np.append(odds, 0.0).astype(np.float32)


@dataclass
class ToxicModel:
    lam: float = 1.0
    k: float = 1.0
    offset: float = 0.0
    slope: float = 1.0

    def p_value(self, s: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return -np.expm1(-self.k * np.maximum(n, 1) * np.exp(-self.lam * s))

    def evidence(self, segments: np.ndarray, n: int) -> float:
        """-log of the chance that clean text has its best segment so high, sharpened by further significant segments."""
        if not len(segments):
            return 0.0
        p = np.sort(np.maximum(self.p_value(segments, n), 1e-40))
        rest = p[1:][p[1:] < ALPHA]
        return float(min(80.0, -np.log(p[0]) - np.log(rest / ALPHA).sum()))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * evidence, -500, 500)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their sums, in order (Ruzzo and Tompa, 1999).

    Runs of tokens without positive score are summed up first, so the scan is over the positive ones."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    left, right = (total[up] - scores[up]).tolist(), total[up].tolist()
    stack: list[list[float]] = []  # start, end, sum before, sum after, index of the nearest earlier one with a lower start
    for x, l, r in zip(up.tolist(), left, right):
        seg = [x, x + 1, l, r, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = int(stack[j][4])
            seg[4] = j
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append(seg)
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3], -1]
            del stack[j:]
    return [(int(a), int(b), r - l) for a, b, l, r, _ in stack]


def _labelled_texts(docs: DataFrame, y: DataFrame) -> DataFrame:
    """(doc_id, text) and (doc_id, toxic) -> text, quarter, n0, n1, weight: one row of each distinct labelled text.

    Where several identical rows stand for a text, their weights sum to 1. Texts meet their labels as hashes; only the
    rows that stand for a text bring it."""
    keys = docs.select("doc_id", F.xxhash64(F.lower("text")).alias("key"))
    rows = keys.join(y, "doc_id").groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.max(1 - F.col("toxic")).alias("n0"), F.max("toxic").alias("n1"))
    least = F.min(F.struct("doc_id", "n")).alias("first")
    one = rows.groupBy("key").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"), least).select(
        F.col("first.doc_id").alias("d"), F.col("key").alias("k"), "n0", "n1", (1 / F.col("first.n")).alias("weight"))
    texts = docs.withColumn("key", F.xxhash64(F.lower("text")))
    found = texts.join(one, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")))
    return found.select("text", _quarter(F.col("key")).alias("quarter"), "n0", "n1", "weight")


def _quarter(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 17), F.lit(QUARTERS)).cast("int")


def use_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Labelled texts -> uses (QUARTERS, 2, SLOTS) of each slot by clean and toxic texts, and texts (QUARTERS, 2).

    Each task sums its texts into arrays of fixed size; their compressed tiles are summed again, and reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros((QUARTERS, 2, SLOTS), np.float32), np.zeros((QUARTERS, 2))
        for b in batches:
            quarter, weight = b.column(1).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            is_ = [b.column(k).to_numpy(zero_copy_only=False) * weight for k in (2, 3)]
            for q in range(QUARTERS):
                for c in (0, 1):
                    seen[q, c] += is_[c][quarter == q].sum()
            for t in text_chunks(b.column(0)):
                h, _, _, doc = words(t, alnum=True, prefixes=STEMS)
                slot = slots(h)
                pair = np.sort((doc[:, None] << 24 | slot).ravel())
                pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
                slot, doc = pair & ((1 << 24) - 1), t.first + (pair >> 24)
                doc, slot = doc[slot < SLOTS], slot[slot < SLOTS]
                for c in (0, 1):
                    for q in range(QUARTERS):
                        mine = (is_[c][doc] > 0) & (quarter[doc] == q)
                        n[q, c] += np.bincount(slot[mine], is_[c][doc[mine]], SLOTS).astype(np.float32) if mine.any() else 0
        flat = np.concatenate([n.ravel(), np.pad(seen.ravel().astype(np.float32), (0, _TILE - seen.size))]).reshape(-1, _TILE)
        some = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([zlib.compress(flat[k].tobytes(), 1) for k in some], pa.binary())], ["tile", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.float32).astype(float)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([zlib.compress(x.astype(np.float32).tobytes(), 1) for x in total.values()], pa.binary())], ["tile", "n"])

    out = np.zeros((QUARTERS * 2 * SLOTS // _TILE + 1, _TILE), np.float32)
    for r in texts.mapInArrow(count, "tile long, n binary").repartition("tile").mapInArrow(add, "tile long, n binary").toLocalIterator():
        out[r["tile"]] = np.frombuffer(zlib.decompress(r["n"]), np.float32)
    return out[:-1].reshape(QUARTERS, 2, SLOTS), out[-1][: QUARTERS * 2].reshape(QUARTERS, 2).astype(float)


def fit_extremes(best: DataFrame) -> tuple[float, float]:
    """(s, n) of clean texts -> lambda and K of the extreme-value law, by maximum likelihood on the upper tail.

    Texts whose best segment lies below the tail only say so. The driver gets one sum for each lambda tried."""
    tail = best.agg(F.percentile_approx("s", _TAIL, 1000)).first()[0]
    if tail is None:
        return 1.0, 1.0
    tail = max(float(tail), 1e-6)
    s, n = F.greatest(F.col("s"), F.lit(tail)), F.greatest(F.col("n"), F.lit(1))
    over = F.col("s") > tail
    sums = best.agg(
        F.sum(over.cast("long")), F.sum(F.when(over, F.col("s")).otherwise(0.0)),
        *[F.sum(n * F.exp(-F.lit(float(x)) * s)) for x in _LAMBDAS]).first()
    count, total, mass = float(sums[0]), float(sums[1]), np.maximum(np.array(sums[2:], float), 1e-300)
    if not count:
        return 1.0, 1.0
    # For a given lambda the likeliest K is count / mass; what remains of the log likelihood:
    likelihood = count * np.log(_LAMBDAS) + count * np.log(count / mass) - _LAMBDAS * total
    k = int(np.argmax(likelihood))
    return float(_LAMBDAS[k]), float(count / mass[k])


def fit_curve(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the logistic curve through n0 clean and n1 toxic texts at each evidence x (Newton steps).

    Both classes have the same weight, so a score says how much the evidence speaks for either, however rare toxic texts are."""
    n1 = n1 * (n0.sum() / max(n1.sum(), 1))
    a = np.stack([np.ones(len(x)), x], 1)
    w = np.array([0.0, 0.1])
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (n1 * (1 - p) - n0 * p) - ridge @ w
        h = (a * ((n0 + n1) * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(max(w[1], 1e-6))


_RAW = "doc_id long, key long, n long, cross array<float>, segments array<struct<start:long,end:long,score:double>>"


def _segments(rows: DataFrame, weights) -> DataFrame:
    """Each row's segments by the weights of all training texts, and the scores of those by the weights of the other
    quarters than its own."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for b in batches:
            quarter = b.column(3).to_numpy(zero_copy_only=False)
            for t in text_chunks(b.column(2)):
                h, a, e, doc = words(t, alnum=True, prefixes=STEMS)
                slot = slots(h)
                score = table[QUARTERS][slot].sum(1) - COST
                crossed = table[quarter[t.first + doc][:, None], slot].sum(1) - COST
                border = np.searchsorted(doc, np.arange(t.n + 1))
                spans, cross = [[] for _ in range(t.n)], [[] for _ in range(t.n)]
                for d in np.unique(doc[score > 0]).tolist():
                    lo, hi = border[d], border[d + 1]
                    spans[d] = [
                        {"start": int(a[lo + x] - t.start[d]), "end": int(e[lo + z - 1] - t.start[d]), "score": v}
                        for x, z, v in maximal_segments(score[lo:hi].astype(float))]
                for d in np.unique(doc[crossed > 0]).tolist():
                    cross[d] = [v for _, _, v in maximal_segments(crossed[border[d] : border[d + 1]].astype(float))]
                part = slice(t.first, t.first + t.n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[part], b.column(1)[part], pa.array(np.diff(border)), pa.array(cross, pa.list_(pa.float32())), pa.array(spans, spans_type)],
                    ["doc_id", "key", "n", "cross", "segments"])

    keyed = rows.select("doc_id", F.xxhash64(F.lower("text")).alias("key"), "text").withColumn("quarter", _quarter(F.col("key")))
    return keyed.select("doc_id", "key", "text", "quarter").mapInArrow(run, _RAW)


def _evidence(found: DataFrame, scores: Column, model: ToxicModel) -> DataFrame:
    """`found` with the evidence of each row's scores, by column expressions."""
    at_chance = lambda s: -F.expm1(-F.lit(model.k) * F.greatest(F.col("n"), F.lit(1)) * F.exp(-F.lit(model.lam) * s))
    p = F.array_sort(F.transform(scores, lambda s: F.greatest(at_chance(s.cast("double")), F.lit(1e-40))))
    first = F.coalesce(-F.log(F.get(p, F.lit(0))), F.lit(0.0))
    rest = F.aggregate(F.slice(p, 2, 1 << 30), F.lit(0.0), lambda acc, x: F.when(x < ALPHA, acc - F.log(x / ALPHA)).otherwise(acc))
    return found.withColumn("evidence", F.least(F.lit(80.0), first + rest))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and labels (doc_id, toxic 0/1) -> doc_id, held_out, score, predicted, segments: one row a document.

    Learns only from rows whose crc32(doc_id as text) mod 3 is not 1. `segments` lists the significant passages as
    (start, end) byte offsets of the UTF-8 text with their score and p-value. Null, empty and wordless texts have no
    evidence and the least score; every text scores 0 if the labels do not hold both classes. Null labels and labels
    other than 0 and 1 teach nothing. Repeated label rows count as their greatest value; a null doc_id matches no label.
    Empty tables give an empty result.
    """
    spark = prepare(docs.sparkSession)
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    y = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id"), FOLD) != HELD)
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    learn = rows.where("doc_id is not null and text is not null").where(fold_of(F.col("doc_id"), FOLD) != HELD)
    uses, texts = use_counts(_labelled_texts(learn, y))
    known = bool((texts.sum(0) > 0).all())
    table = np.zeros((QUARTERS + 1, SLOTS + 1), np.float32)
    if known:
        for q in range(QUARTERS + 1):
            n, t = (uses.sum(0), texts.sum(0)) if q == QUARTERS else (uses.sum(0) - uses[q], texts.sum(0) - texts[q])
            if (t > 0).all():
                table[q] = log_odds(n[0], n[1], t[0], t[1])
    found = cut(_segments(rows, spark.sparkContext.broadcast(table)))
    model = ToxicModel()
    if known:
        truth = found.where(fold_of(F.col("doc_id"), FOLD) != HELD).join(y, "doc_id").dropDuplicates(["key", "toxic"])
        model.lam, model.k = fit_extremes(truth.where("toxic = 0").select(F.coalesce(F.array_max("cross"), F.lit(0.0)).cast("double").alias("s"), "n"))
        bins = _evidence(truth, F.col("cross"), model).groupBy((F.round(F.col("evidence") * 10) / 10).alias("x")).agg(
            F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1")).toPandas()  # at most 801 rows
        model.offset, model.slope = fit_curve(*(bins[c].to_numpy(float) for c in ("x", "n0", "n1")))
    done = _evidence(found, F.col("segments.score"), model)
    score = 1 / (1 + F.exp(-(F.lit(model.offset) + F.lit(model.slope) * F.col("evidence")))) if known else F.lit(0.0)
    p = lambda s: -F.expm1(-F.lit(model.k) * F.greatest(F.col("n"), F.lit(1)) * F.exp(-F.lit(model.lam) * s["score"]))
    spans = F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), p(s).alias("p")))
    return done.withColumn("score", score).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.filter(spans, lambda s: s["p"] < ALPHA).alias("segments"),
    )
