"""Exact cosine search over aligned vectors, multi-view means, guarded semantic matches, fusion and diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, ARM, POOL, LAMBDA = 60, 100, 50, 0.80


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def score_all(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, embedding) x (query, vector) -> (query, key, cosine). Queries are the small side and are broadcast."""
    return vectors.crossJoin(F.broadcast(queries)).select(
        "query", "key", (dot(F.col("embedding"), F.col("vector")) / (norm(F.col("embedding")) * norm(F.col("vector")))).alias("cosine")
    )


def multi_view(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query, key, view, cosine, present) -> weighted mean over the views that are there, 0 without any."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col("view")]
    s = F.sum(F.when(F.col("present"), w * F.col("cosine")))
    n = F.sum(F.when(F.col("present"), w))
    return scores.groupBy("query", "key").agg(F.coalesce(s / n, F.lit(0.0)).alias("score"))


def ranked(scores: DataFrame, score: str, k: int, positive_only: bool = False) -> DataFrame:
    """(query, key, score) -> the first k by score, then key, with their ranks."""
    rows = scores.where(F.col(score) > 0) if positive_only else scores
    order = Window.partitionBy("query").orderBy(F.desc(score), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(*arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """Ranked arms (query, key, rank) -> (query, key, fusion)."""
    rows = arms[0].select("query", "key", "rank")
    for a in arms[1:]:
        rows = rows.unionByName(a.select("query", "key", "rank"))
    return rows.groupBy("query", "key").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fusion"))


def guarded_match(scores: DataFrame, least: float = 0.90, margin: float = 0.0, count: int = 10) -> DataFrame:
    """(query, key, cosine, count) -> the best key if it is frequent, similar and clear enough."""
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    rows = scores.where(F.col("count") >= count).withColumn("second", F.lead("cosine").over(order)).withColumn("r", F.row_number().over(order))
    return rows.where((F.col("r") == 1) & (F.col("cosine") >= least) & (F.col("second").isNull() | (F.col("cosine") - F.col("second") >= margin))).drop("r", "second")


def mmr(pool: DataFrame, limit: int, lam: float = LAMBDA) -> DataFrame:
    """(query, key, fusion, bonus, embedding) -> (query, key, position, mmr): greedy diversity over a bounded pool.

    value = lam * fusion / peak - (1 - lam) * max(0, cosine to the chosen); ties by value + bonus, value, fusion, key.
    The pool of a query is at most POOL rows, so one task holds it."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("key").reset_index(drop=True)
        x = np.stack(p["embedding"].to_numpy()).astype(float)
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        sim, rel = x @ x.T, p["fusion"].to_numpy(float) / max(p["fusion"].max(), 1e-300)
        bonus, near, left, out = p["bonus"].to_numpy(float), np.zeros(len(p)), list(range(len(p))), []
        for position in range(1, min(limit, len(p)) + 1):
            value = lam * rel - (1 - lam) * near
            best = max(left, key=lambda i: (round(value[i] + bonus[i], 12), round(value[i], 12), rel[i], -i))
            out.append((p["query"][best], p["key"][best], position, value[best]))
            left.remove(best)
            near = np.maximum(near, sim[best])
        return pd.DataFrame(out, columns=["query", "key", "position", "mmr"])

    top = ranked(pool, "fusion", POOL)
    q, k = pool.schema["query"].dataType.simpleString(), pool.schema["key"].dataType.simpleString()
    return top.select("query", "key", "fusion", "bonus", "embedding").groupBy("query").applyInPandas(run, f"query {q}, key {k}, position int, mmr double")


def embed(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], key: str = "key", text: str = "text") -> DataFrame:
    """(key, embedding) by an injected encoder, a batch at a time; equal texts of a batch are encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            distinct = sorted(set(b[text].fillna("")), key=lambda x: (len(x), x))
            if distinct:
                at = dict(zip(distinct, np.asarray(encoder(distinct), float)))
                yield pd.DataFrame({key: b[key], "embedding": [at[x].tolist() for x in b[text].fillna("")]})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def hash_encoder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for a model: signed hashed token counts, unit length."""
    import hashlib
    import re

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, x in enumerate(texts):
            for token in re.findall(r"\w+", x.lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(n > 0, n, 1)

    return run
