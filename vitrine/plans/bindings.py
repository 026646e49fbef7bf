"""The driver's tables as the engine's inputs, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("asin")).agg((F.avg("l_quantity") / 10).alias("rating"))
    part = table(spark, sf_dir, "part")
    name = F.split("p_name", " ")
    return part.select(
        F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"), name[0].alias("color"), name[1].alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("style"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice")).alias("price"),
    ).join(rating, "asin", "left")


PRODUCTS = """products AS (
  SELECT p_partkey AS asin, p_name AS title, split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS category, p_brand AS brand,
    p_type AS style, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price, r.rating
  FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) / 10 AS rating FROM lineitem GROUP BY l_partkey) r ON r.l_partkey = p_partkey)"""

FACETS = ("color", "category", "brand", "style")
LONG = "long AS (" + " UNION ALL ".join(f"SELECT asin, '{a}' AS attribute, {a} AS value FROM products" for a in FACETS) + ")"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return e.select(
        F.col("user_id").alias("session"), F.row_number().over(order).alias("turn"), (F.col("event_type") == "purchase").alias("hit"),
        (F.col("event_id") % 10 + 1).cast("int").alias("rank"), (F.col("event_type") == "signup").alias("override"), F.col("value").alias("latency"),
        (F.col("user_id") % 4).cast("int").alias("scenario"), "event_id", "event_type",
    )


TURNS = """turns AS (
  SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type = 'purchase' AS hit,
    event_id % 10 + 1 AS rank, event_type = 'signup' AS override, value AS latency, user_id % 4 AS scenario, event_id, event_type FROM events)"""

RESULTS = """results AS (
  SELECT session, scenario, coalesce(bool_or(hit AND turn <= 10), false) AS hit, min(turn) FILTER (hit AND turn <= 10) AS first_turn,
    arg_min(rank, turn) FILTER (hit AND turn <= 10) AS best_rank FROM turns GROUP BY session, scenario)"""
