"""Session-level evaluation: hit rate, MRR, turns to hit, curves, histograms, latencies, deltas, promotion and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_bucket
from .facets import MAX_TURNS, MISS_TURN, utility


def session_results(turns: DataFrame, *keep: str) -> DataFrame:
    """(session, turn, hit, rank) -> (session, hit, first_turn, best_rank): a hit counts from the
    session's `override_turn` on, where there is such a column."""
    ok = F.col("hit") & (F.col("turn") <= MAX_TURNS)
    if "override_turn" in turns.columns:
        ok = ok & (F.col("turn") >= F.coalesce("override_turn", F.lit(1)))
    return turns.groupBy("session", *keep).agg(
        F.max(F.coalesce(ok, F.lit(False))).alias("hit"),
        F.min(F.when(ok, F.col("turn"))).alias("first_turn"),
        F.min_by(F.when(ok, F.col("rank")), F.when(ok, F.col("turn"))).alias("best_rank"),
    )


def metric_columns() -> list[Column]:
    hit, mrr = F.avg(F.col("hit").cast("double")), F.avg(F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0)))
    mttc = F.avg(F.coalesce("first_turn", F.lit(MISS_TURN)).cast("double"))
    eff = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (MISS_TURN - mttc) / 10))
    return [
        F.count("*").alias("sessions"), F.round(hit, 6).alias("hit_rate"), F.round(mrr, 6).alias("mrr"), F.round(mttc, 6).alias("mttc"),
        F.round(eff, 6).alias("efficiency"), F.round(0.5 * hit + 0.3 * mrr + 0.2 * eff, 6).alias("technical"),
    ]


def metrics(results: DataFrame) -> DataFrame:
    return results.agg(*metric_columns())


def metrics_by_scenario(results: DataFrame) -> DataFrame:
    """Each scenario and, as null, all sessions."""
    return results.rollup("scenario").agg(*metric_columns())


def turn_curve(results: DataFrame, turns: DataFrame, cumulative: bool = True) -> DataFrame:
    """Turns 1 to 10: sessions seen, hits first made, cumulative hits and their share of all sessions."""
    spark = results.sparkSession
    every = spark.range(1, MAX_TURNS + 1).select(F.col("id").cast("int").alias("turn"))
    seen = turns.groupBy("turn").agg(F.countDistinct("session").alias("samples"), F.avg("latency").alias("mean_latency"))
    hits = results.where("hit").groupBy(F.col("first_turn").alias("turn")).agg(F.count("*").alias("turn_hits"))
    n = results.agg(F.count("*").alias("n"))
    rows = every.join(F.broadcast(seen), "turn", "left").join(F.broadcast(hits), "turn", "left").crossJoin(F.broadcast(n))
    total = F.sum(F.coalesce("turn_hits", F.lit(0))).over(Window.orderBy("turn"))
    hits_so_far = total if cumulative else F.coalesce("turn_hits", F.lit(0))
    return rows.select(
        "turn", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("turn_hits", F.lit(0)).alias("turn_hits"),
        hits_so_far.alias("cumulative_hits"), F.round(hits_so_far / F.col("n"), 6).alias("cumulative_rate"), F.round("mean_latency", 6).alias("mean_latency"),
    )


def rank_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy(rank_bucket(F.col("best_rank")).alias("bucket")).agg(F.count("*").alias("n"))


def latency_percentiles(rows: DataFrame, value: str, *group: str, fractions: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles, mean and total."""
    p = [F.round(F.expr(f"percentile_disc({f}) within group (order by {value})"), 6).alias(f"p{int(f * 100)}") for f in fractions]
    return rows.groupBy(*group).agg(*p, F.round(F.avg(value), 6).alias("mean"), F.round(F.sum(value), 4).alias("total"))


def counter_deltas(rows: DataFrame, session: str, order: str, counter: str, family: Column) -> DataFrame:
    """Positive changes against the session's previous snapshot, summed by family."""
    d = F.col(counter) - F.lag(counter).over(Window.partitionBy(session).orderBy(order))
    return rows.withColumn("family", family).withColumn("delta", d).where("delta > 0").groupBy("family").agg(
        F.count("*").alias("changes"), F.round(F.sum("delta"), 4).alias("delta"))


def promotion_stats(turns: DataFrame) -> DataFrame:
    """Per rank: observations with a next turn, P(next is 1), P(next is better)."""
    nxt = F.lead("rank").over(Window.partitionBy("session").orderBy("turn"))
    rows = turns.withColumn("next", nxt).where("next is not null")
    return rows.groupBy("rank").agg(
        F.count("*").alias("observations"), F.round(F.avg((F.col("next") == 1).cast("double")), 6).alias("p_first"),
        F.round(F.avg((F.col("next") < F.col("rank")).cast("double")), 6).alias("p_better"))


def session_values(turns: DataFrame) -> DataFrame:
    """Per session: the value of stopping at the first hit, and the best value in hindsight; a hit without a rank has none."""
    v = F.when(F.col("hit") & (F.col("turn") <= MAX_TURNS) & F.col("rank").isNotNull(), utility(F.col("turn"), F.col("rank")))
    return turns.withColumn("v", v).groupBy("session").agg(
        F.coalesce(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("turn"))), F.lit(0.0)).alias("greedy"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("oracle"))


def value_upside(values: DataFrame) -> DataFrame:
    return values.agg(
        F.round(F.avg("greedy"), 6).alias("greedy"), F.round(F.avg("oracle"), 6).alias("oracle"),
        F.round(F.avg(F.col("oracle") - F.col("greedy")), 6).alias("upside"), F.count_if(F.col("oracle") > F.col("greedy")).alias("improved"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """(gold, predicted) of 0/1 -> accuracy and the mean F1 of both labels."""
    def f1(k: int) -> Column:
        tp = F.count_if((F.col("gold") == k) & (F.col("predicted") == k))
        n = F.count_if(F.col("gold") == k) + F.count_if(F.col("predicted") == k)
        return F.when(n > 0, 2.0 * tp / n).otherwise(0.0)

    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("accuracy"),
                    F.round((f1(0) + f1(1)) / 2, 6).alias("macro_f1"))


def calibration(rows: DataFrame) -> DataFrame:
    """(confidence, correct) -> accuracy in [.5, .6), [.6, .7), [.7, .85), [.85, 1]."""
    c = F.col("confidence")
    b = F.when(c < 0.6, "0.50-0.60").when(c < 0.7, "0.60-0.70").when(c < 0.85, "0.70-0.85").otherwise("0.85-1.00")
    return rows.where(c >= 0.5).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(gold, score) -> accuracy of score >= threshold, for each of a few thresholds."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    return rows.withColumn("threshold", t).groupBy("threshold").agg(
        F.round(F.avg(((F.col("score") >= F.col("threshold")).cast("int") == F.col("gold")).cast("double")), 6).alias("accuracy"),
        F.count_if(F.col("score") >= F.col("threshold")).alias("positive"))


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """One row for each broken rule of a row: the rule's name next to the row's key columns."""
    found = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("violation", F.explode(found))


def valid_recommendations(rows: DataFrame, catalog: DataFrame, limit: int = 10) -> DataFrame:
    """(session, recommendations) -> (session, asin, position): catalog ids only, first of each, in order, at most `limit`."""
    each = rows.select("session", F.posexplode("recommendations").alias("pos", "asin"))
    known = each.join(catalog.select("asin"), "asin", "left_semi").groupBy("session", "asin").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("session").orderBy("pos")
    return known.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("session", "asin", "position")
