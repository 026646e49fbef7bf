"""Retrieval as one composed plan: eligibility, scores, the two modes, top-k, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_rating, rating_weight, words
from .dense import ARM, POOL, mmr, ranked, reciprocal_rank_fusion


def eligible(products: DataFrame, price_min: float | None = None, price_max: float | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Inclusive bounds, under which an unknown price is out; already shown products are out."""
    rows = products
    if price_min is not None:
        rows = rows.where(F.col("price") >= price_min)
    if price_max is not None:
        rows = rows.where(F.col("price") <= price_max)
    return rows if excluded is None else rows.join(excluded.select("asin"), "asin", "left_anti")


def eligible_counts(sessions: DataFrame, shown: DataFrame, products: DataFrame) -> DataFrame:
    """(session) and shown (session, asin) -> session, eligible: products that a session has not been shown yet."""
    seen = shown.distinct().join(products.select("asin"), "asin", "left_semi").groupBy("session").agg(F.count("*").alias("seen"))
    total = products.agg(F.count("*").alias("total"))
    return sessions.join(seen, "session", "left").crossJoin(total).select("session", (F.col("total") - F.coalesce("seen", F.lit(0))).alias("eligible"))


def top_k(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best by score, then catalog order; score and order end in TakeOrderedAndProject."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), "asin").limit(k)


def rating_bonus(prior_rating: float | None) -> Column:
    return rating_weight(F.lit(prior_rating).cast("double")) * normalized_rating(F.col("rating").cast("string"))


def buying(products: DataFrame, slots: DataFrame, summary: DataFrame, prior_rating: float | None, k: int) -> DataFrame:
    """(asin, bm25) and (asin, raw) -> fused slot score plus raw summary score plus rating bonus. Every eligible product ranks."""
    rows = products.join(slots, "asin", "left").join(summary, "asin", "left")
    base = F.coalesce("bm25", F.lit(0.0)) + F.coalesce("raw", F.lit(0.0))
    return top_k(rows, base + rating_bonus(prior_rating), k)


def browsing(products: DataFrame, dense: DataFrame, sparse: DataFrame, vectors: DataFrame, prior_rating: float | None, k: int,
             empty_dense: str = "skip") -> DataFrame:
    """Fuses the dense and sparse arms (query, key, score) by rank, then diversifies the pool."""
    arms = [ranked(sparse.withColumnRenamed("score", "s"), "s", ARM, positive_only=True)]
    if empty_dense == "catalog_prefix" or not dense.isEmpty():
        arms.append(ranked(dense.withColumnRenamed("score", "s"), "s", ARM))
    fused = reciprocal_rank_fusion(*arms)
    pool = ranked(fused, "fusion", POOL).join(vectors, "key").join(products.select(F.col("asin").alias("key"), "rating"), "key")
    return mmr(pool.withColumn("bonus", rating_bonus(prior_rating)).drop("rank"), k)


def title_search(products: DataFrame, query: str, k: int) -> DataFrame:
    """Query terms found in the title, with a bonus for the whole phrase."""
    terms = [t for t in query.lower().split() if t]
    title = F.lower("title")
    n = sum((F.contains(title, F.lit(t)).cast("int") for t in terms), F.lit(0))
    phrase = F.contains(title, F.lit(" ".join(terms))).cast("int")
    return products.withColumn("terms", n).withColumn("phrase", phrase).where("terms > 0").orderBy(F.desc("phrase"), F.desc("terms"), "asin").limit(k)


def fill_to_k(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Ordered union of (asin, pos) lists without repeats, at most k."""
    rows = first.select("asin", "pos", F.lit(0).alias("src")).unionByName(second.select("asin", "pos", F.lit(1).alias("src")))
    each = rows.groupBy("asin").agg(F.min(F.struct("src", "pos")).alias("at"))
    return each.orderBy("at.src", "at.pos", "asin").limit(k).select("asin", "at.src", "at.pos")


def term_overlap(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    return rows.withColumn("overlap", F.size(F.array_intersect(F.array_distinct(words(F.col(text))), F.array(*[F.lit(t) for t in terms]))))


def rating_order(rows: DataFrame) -> DataFrame:
    """Backfill for critical shoppers: by rating, retrieval order among equals."""
    order = Window.partitionBy("query").orderBy(F.desc(normalized_rating(F.col("rating").cast("string"))), "rank")
    return rows.withColumn("position", F.row_number().over(order))
