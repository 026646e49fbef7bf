"""Slot state to lexical query groups: active values, a few expansions from semantic evidence, then unevidenced values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_value, normalize_text
from .bm25 import COLUMN_WEIGHTS, SLOT_COLUMNS

#: Expansions of a slot, their least confidence and greatest distance to the best.
EXPANSIONS, LEAST, GAP = 3, 0.82, 0.08


def _added(terms: Column, items: Column) -> Column:
    """struct(terms, n): up to EXPANSIONS items (value, raw), each of which must add a term that is not there yet."""
    start = F.struct(terms.alias("terms"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        new = F.array_distinct(F.filter(F.concat(acc["terms"], F.array(x["value"], x["raw"])), lambda t: t != ""))
        grows = (F.size(new) > F.size(acc["terms"])) & (acc["n"] < EXPANSIONS)
        return F.when(grows, F.struct(new.alias("terms"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(items, start, add)["terms"]


def compile_groups(active: DataFrame, evidence: DataFrame, semantic: DataFrame) -> DataFrame:
    """Active values (query, slot, pos, value), semantic evidence (query, slot, canonical_id, raw_text, confidence) and
    semantic values (query, slot, pos, value) -> query, slot, phrases, columns: one group for each slot with a term.

    Expansions go by confidence, then text; NaN counts as 0. A semantic value that evidence names needs no term of its own."""
    empty = F.array().cast("array<string>")
    listed = lambda df, name: df.groupBy("query", "slot").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", normalize_text(F.col("value")).alias("v")))), lambda x: x["v"]).alias(name))
    score = F.when(F.isnan("confidence"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    e = evidence.withColumn("score", score).withColumn("value", normalize_text(canonical_value(F.col("canonical_id")))).withColumn("raw", normalize_text(F.col("raw_text")))
    named = e.groupBy("query", "slot").agg(F.collect_set("value").alias("named"))
    spoken = e.where("trim(raw_text) <> ''").withColumn("best", F.max("score").over(Window.partitionBy("query", "slot")))
    kept = spoken.where((F.col("score") >= LEAST) & (F.col("best") - F.col("score") <= GAP))
    items = kept.groupBy("query", "slot").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "raw_text", "value", "raw"))).alias("items"))
    slots = active.select("query", "slot").unionByName(evidence.select("query", "slot")).unionByName(semantic.select("query", "slot")).distinct()
    rows = slots
    for df in (listed(active, "mine"), items, named, listed(semantic, "other")):
        rows = rows.join(df, ["query", "slot"], "left")
    terms = F.array_distinct(F.filter(F.coalesce("mine", empty), lambda t: t != ""))
    none = F.expr("cast(array() as array<struct<s:double,raw_text:string,value:string,raw:string>>)")
    rows = rows.withColumn("terms", terms).withColumn("grown", _added(F.col("terms"), F.coalesce("items", none)))
    more = F.filter(F.coalesce("other", empty), lambda t: (t != "") & ~F.array_contains(F.coalesce("named", empty), t))
    phrases = F.array_distinct(F.concat("grown", more))
    columns = F.create_map(*[x for k, v in SLOT_COLUMNS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    return rows.select("query", "slot", phrases.alias("phrases"), F.try_element_at(columns, F.col("slot")).alias("columns")).where(
        "size(phrases) > 0 and columns is not null")


def phrase_table(groups: DataFrame) -> DataFrame:
    """Groups -> (query, slot, phrase, column, weight) for the lexical search."""
    weights = F.create_map(*[x for k, v in COLUMN_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return groups.select("query", "slot", F.explode("phrases").alias("phrase"), "columns").select(
        "query", "slot", "phrase", F.explode("columns").alias("column")).withColumn("weight", weights[F.col("column")])


def expression(phrases: Column, columns: Column) -> Column:
    """A group as match-expression text: {columns} : ("phrase" OR "phrase")."""
    quoted = F.transform(phrases, lambda p: F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(columns, " "), F.lit("} : ("), F.array_join(quoted, " OR "), F.lit(")"))
