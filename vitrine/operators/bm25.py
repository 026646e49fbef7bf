"""Field-weighted BM25 with phrase queries, column routing and slot fusion.

idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; the frequency of a phrase in a document is the sum of the weights of
the columns it occurs in, once an occurrence; length counts all columns; N, n and the mean length are over all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

K1, B = 1.2, 0.75
#: Column weights and the columns that each slot searches.
COLUMN_WEIGHTS = {
    "category": 4.0, "brand": 1.5, "color": 2.5, "material": 2.5, "feature": 2.5, "use_case": 2.5, "style": 6.0,
    "title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0,
}
SLOT_COLUMNS = {
    "category": ("category", "categories", "title"), "brand": ("brand", "title", "store"), "color": ("color", "title", "features"),
    "material": ("material", "features", "details"), "feature": ("feature", "features", "details", "description"),
    "use_case": ("use_case", "features", "description", "categories"), "style": ("style", "title", "features"),
}


def index_columns(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, column, tokens): the analysed columns of each document."""
    parts = [F.struct(F.lit(c).alias("column"), words(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for c in columns]
    return rows.select(F.col(key).alias("key"), F.explode(F.array(*parts)).alias("x")).select("key", "x.column", "x.tokens")


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query, phrase, column weights...) -> (query, phrase, key, f): weighted occurrences by n-gram equality.

    phrases: query, phrase, column, weight. Only n-grams of lengths that the phrases have are made; phrases, which come
    from a query, are the small side."""
    wanted = phrases.withColumn("n", F.size(F.split("phrase", " ")))
    grams = index.join(F.broadcast(wanted.select("column", "n").distinct()), "column").select(
        "key", "column", F.explode(F.when(
            F.size("tokens") >= F.col("n"),
            F.expr("transform(sequence(1, size(tokens) - n + 1), i -> array_join(slice(tokens, i, n), ' '))"))).alias("phrase"))
    return grams.join(F.broadcast(phrases), ["column", "phrase"]).groupBy("query", "phrase", "key").agg(F.sum("weight").alias("f"))


def bm25_phrases(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query, phrase, key, score): each phrase's share of the score."""
    lengths = index.groupBy("key").agg(F.sum(F.size("tokens")).alias("len"))
    stats = lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    hits = phrase_hits(index, phrases)
    df = hits.groupBy("query", "phrase").agg(F.countDistinct("key").alias("n"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    tf = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hits.join(df, ["query", "phrase"]).join(lengths, "key").crossJoin(F.broadcast(stats)).select("query", "phrase", "key", (idf * tf).alias("score"))


def bm25_search(index: DataFrame, phrases: DataFrame) -> DataFrame:
    return bm25_phrases(index, phrases).groupBy("query", "key").agg(F.sum("score").alias("score"))


def slot_fusion(scores: DataFrame) -> DataFrame:
    """(query, slot, key, score) -> (query, key, bm25): each slot by its peak, in [0, 1], mean over slots with matches."""
    peak = F.max("score").over(Window.partitionBy("query", "slot"))
    slots = scores.groupBy("query").agg(F.countDistinct("slot").alias("slots"))
    part = scores.withColumn("part", F.least(F.lit(1.0), F.when(peak > 0, F.col("score") / peak).otherwise(0.0)))
    return part.groupBy("query", "key").agg(F.sum("part").alias("s")).join(slots, "query").select("query", "key", (F.col("s") / F.col("slots")).alias("bm25"))


def explain(scores: DataFrame) -> DataFrame:
    """(query, slot, key, score) -> per slot: matches, peak, best key."""
    return scores.groupBy("query", "slot").agg(
        F.count("*").alias("matches"), F.max("score").alias("peak"), F.max_by("key", F.struct("score", -F.col("key"))).alias("best")
    )
