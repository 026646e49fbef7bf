"""Facts, the canonical attribute registry, posting joins and structured scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_id, normalize_text

#: Weight of a matched field in the structured score.
STRUCTURED_WEIGHTS = {"category": 0.7, "price": 1.5, "brand": 7.0, "size": 0.8, "color": 1.0, "material": 1.2, "style": 0.5, "feature": 0.5, "use_case": 0.5}


def first_wins(rows: DataFrame, *keys: str, order_by: str) -> DataFrame:
    """The first row of each key in the given order."""
    order = Window.partitionBy(*keys).orderBy(order_by)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def facts_or_raw(catalog: DataFrame, facts: DataFrame, key: str, *fields: str) -> DataFrame:
    """Left join; a fact that is there replaces the catalog's own value."""
    f = facts.select(key, *[F.col(c).alias(f"_f_{c}") for c in fields])
    return catalog.join(f, key, "left").select(
        *[c for c in catalog.columns if c not in fields], *[F.coalesce(f"_f_{c}", c).alias(c) for c in fields]
    )


def attribute_tables(catalog: DataFrame, long: DataFrame, attributes: tuple[str, ...], key: str = "asin") -> DataFrame:
    """(key, attribute, value) -> one row a product with a list column for each attribute, [] where it has none."""
    wide = long.groupBy(key).pivot("attribute", list(attributes)).agg(F.sort_array(F.collect_set("value")))
    empty = F.array().cast("array<string>")
    return catalog.select(key).join(wide, key, "left").select(key, *[F.coalesce(a, empty).alias(a) for a in attributes])


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right_only"))
    )


def unpivot(rows: DataFrame, key: str, *attributes: str) -> DataFrame:
    """(key, attribute, value) without nulls and blanks."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])
    return rows.select(F.col(key), F.explode(pairs).alias("x")).select(key, "x.attribute", "x.value").where("value is not null and trim(value) <> ''")


def build_registry(long: DataFrame, key: str = "asin") -> DataFrame:
    """(key, attribute, value) -> canonical_id, attribute, normalized, value (least display form), count (products), variants."""
    rows = long.withColumn("normalized", normalize_text(F.col("value"))).where("normalized <> ''")
    return rows.groupBy("attribute", "normalized").agg(
        F.countDistinct(key).alias("count"), F.min("value").alias("value"), F.countDistinct("value").alias("variants")
    ).withColumn("canonical_id", canonical_id(F.col("attribute"), F.col("value")))


def ambiguous_surfaces(registry: DataFrame) -> DataFrame:
    """Normalised forms that several attributes have."""
    return registry.groupBy("normalized").agg(
        F.countDistinct("attribute").alias("attributes"), F.array_join(F.sort_array(F.collect_set("canonical_id")), ",").alias("ids")
    ).where("attributes > 1")


def lookup(surfaces: DataFrame, registry: DataFrame) -> DataFrame:
    """(surface) -> each canonical candidate; ambiguity stays."""
    return surfaces.withColumn("normalized", normalize_text(F.col("surface"))).join(registry, "normalized")


def dominant(counts: DataFrame, *group: str, share: float = 0.75, ratio: float = 3.0) -> DataFrame:
    """(group, value, n) -> the most frequent value where it dominates: top share and ratio to the runner-up."""
    order = Window.partitionBy(*group).orderBy(F.desc("n"), "value")
    rows = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*group))).withColumn("second", F.lead("n").over(order)).withColumn("_r", F.row_number().over(order))
    top = rows.where("_r = 1")
    return top.where((F.col("n") >= share * F.col("total")) & (F.col("second").isNull() | (F.col("n") >= ratio * F.col("second")))).drop("_r")


def with_all_tags(long: DataFrame, tags: list[tuple[str, str]], key: str = "asin") -> DataFrame:
    """Products that have every (attribute, value): relational division."""
    one = reduce(lambda a, b: a | b, [(F.col("attribute") == a) & (F.col("value") == v) for a, v in tags])
    return long.where(one).groupBy(key).agg(F.countDistinct("attribute", "value").alias("n")).where(F.col("n") == len(tags)).select(key)


def structured_scores(long: DataFrame, constraints: DataFrame, key: str = "asin") -> DataFrame:
    """(query, attribute, value) -> (query, key, score, labels): weights of the matched fields, each once."""
    matched = long.join(F.broadcast(constraints), ["attribute", "value"]).select("query", key, "attribute").distinct()
    weight = F.create_map(*[x for k, v in STRUCTURED_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return matched.groupBy("query", key).agg(
        F.sum(weight[F.col("attribute")]).alias("score"), F.array_join(F.sort_array(F.collect_set("attribute")), ",").alias("matched")
    )


def canonical_scores(long: DataFrame, evidence: DataFrame, key: str = "asin") -> DataFrame:
    """(query, attribute, value, similarity) -> (query, key, score): greatest similarity of each value, in [0, 1], null is 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("similarity", F.lit(1.0))))
    best = evidence.withColumn("s", s).groupBy("query", "attribute", "value").agg(F.max("s").alias("s"))
    return long.join(F.broadcast(best), ["attribute", "value"]).groupBy("query", key).agg(F.sum("s").alias("score"))
