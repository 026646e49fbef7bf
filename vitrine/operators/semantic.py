"""Semantic lookup of phrases among canonical values: guarded top-k, best of n-grams, exact first; checks of the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .dense import score_all

#: Least similarity of a match, least products of a value, attributes with vectors, in order.
FLOOR, LEAST_COUNT = 0.90, 10
ATTRIBUTES = ("category", "color", "material", "style", "feature", "use_case")


def _order(attribute: str = "attribute"):
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(a) for a in ATTRIBUTES]), F.col(attribute)), F.lit(0)), F.lit(99))


def candidates(queries: DataFrame, values: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """Queries (query, vector) and values (canonical_id, attribute, count, embedding) -> each pair's similarity.

    Rare values are left out before any similarity is looked at."""
    kept = values.where(F.col("count") >= least_count)
    scored = score_all(kept.select(F.col("canonical_id").alias("key"), "embedding"), queries)
    return scored.select("query", F.col("key").alias("canonical_id"), F.col("cosine").alias("similarity")).join(
        kept.select("canonical_id", "attribute", "count"), "canonical_id")


def semantic_match(scored: DataFrame, top_k: int = 1, floor: float = FLOOR, margin: float = 0.0) -> DataFrame:
    """The best values of each query: per attribute the top_k, none if the best is below the floor or leads the second of
    them by less than the margin; then the top_k over attributes by similarity, attribute order and id."""
    view = Window.partitionBy("query", "attribute").orderBy(F.desc("similarity"), "canonical_id")
    rows = scored.withColumn("place", F.row_number().over(view)).where(F.col("place") <= top_k)
    whole = Window.partitionBy("query", "attribute")
    best = F.max("similarity").over(whole)
    second = F.max(F.when(F.col("place") == 2, F.col("similarity"))).over(whole)
    fine = (F.col("best") >= floor) & (F.col("second").isNull() | (F.col("best") - F.col("second") >= margin))
    rows = rows.withColumn("best", best).withColumn("second", second).where(fine).where(F.col("similarity") >= floor)
    every = Window.partitionBy("query").orderBy(F.desc("similarity"), _order(), "canonical_id")
    return rows.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top_k).select(
        "query", "rank", "canonical_id", "attribute", "similarity")


def best_of_ngrams(scored: DataFrame, owner: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Scored n-grams (query = n-gram) and the texts that have them (text_id, query) -> every value at the floor, once a
    text, with its best n-gram."""
    hits = scored.where(F.col("similarity") >= floor).join(owner, "query")
    best = hits.groupBy("text_id", "canonical_id", "attribute").agg(F.max("similarity").alias("similarity"), F.max_by("query", "similarity").alias("query"))
    every = Window.partitionBy("text_id").orderBy(F.desc("similarity"), _order(), "canonical_id")
    return best.withColumn("rank", F.row_number().over(every))


def resolve(surfaces: DataFrame, registry: DataFrame, semantic: DataFrame) -> DataFrame:
    """(surface) -> surface, canonical_id, method: the one exact value; null if several are exact; else the best semantic
    match (query, rank, canonical_id) of the surface, if any."""
    exact = surfaces.withColumn("normalized", normalize_text(F.col("surface"))).join(registry.select("normalized", "canonical_id"), "normalized")
    count = exact.groupBy("surface").agg(F.count("*").alias("n"), F.min("canonical_id").alias("exact"))
    near = semantic.where("rank = 1").select(F.col("query").alias("surface"), F.col("canonical_id").alias("near"))
    method = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("near").isNotNull(), "semantic").otherwise("none")
    value = F.when(F.col("n") == 1, F.col("exact")).when(F.col("n").isNull(), F.col("near"))
    return surfaces.join(count, "surface", "left").join(near, "surface", "left").select("surface", value.alias("canonical_id"), method.alias("method"))


def examples(long: DataFrame, most: int = 3) -> DataFrame:
    """(asin, attribute, value) -> attribute, normalized, asins: the first products of each surface."""
    rows = long.select("attribute", normalize_text(F.col("value")).alias("normalized"), "asin").where("normalized <> ''").distinct()
    order = Window.partitionBy("attribute", "normalized").orderBy("asin")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy("attribute", "normalized").agg(
        F.sort_array(F.collect_list("asin")).alias("asins"))


def registry_problems(registry: DataFrame, lookup: DataFrame) -> DataFrame:
    """A registry (canonical_id, attribute, normalized, count) and its lookup (normalized, canonical_id) -> (problem, id)."""
    expect = F.concat(F.col("attribute"), F.lit(":"), F.replace("normalized", F.lit(" "), F.lit("_")))
    bad = registry.select("canonical_id", F.array_compact(F.array(
        F.when(F.col("canonical_id") != expect, "wrong_id"), F.when(F.col("count") < 1, "no_products"),
        F.when(F.col("normalized") != normalize_text(F.col("normalized")), "not_normalized"),
        F.when(~F.col("attribute").isin("brand", *ATTRIBUTES), "unknown_attribute"))).alias("p")).select(F.explode("p").alias("problem"), F.col("canonical_id").alias("id"))
    twice = registry.groupBy("canonical_id").count().where("count > 1").select(F.lit("repeated_id").alias("problem"), F.col("canonical_id").alias("id"))
    a, b = registry.select("normalized", "canonical_id").distinct(), lookup.select("normalized", "canonical_id").distinct()
    missing = a.exceptAll(b).select(F.lit("not_in_lookup").alias("problem"), F.col("canonical_id").alias("id"))
    extra = b.exceptAll(a).select(F.lit("not_in_registry").alias("problem"), F.col("canonical_id").alias("id"))
    return bad.unionByName(twice).unionByName(missing).unionByName(extra)
