"""Ways to rank and explain one list of candidates: modes without diversity, re-sorts, prefix and tail, holding back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facets import MAX_TURNS, promotion_threshold
from .registry import STRUCTURED_WEIGHTS

#: Names that a retrieval mode goes by.
MODES = {"buying": "BUYING", "browsing": "BROWSING", "qwen_dense": "DENSE", "dense": "DENSE"}


def mode_of(name: str) -> str:
    """The mode that a name stands for; an unknown one is an error."""
    try:
        return MODES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown retrieval mode: {name!r}") from None


def dense_source(artifacts: dict[str, DataFrame | None]) -> DataFrame | None:
    """The first dense index there is: the product index, then the multi-view one, then the legacy one."""
    return next((artifacts[k] for k in ("product", "views", "legacy") if artifacts.get(k) is not None), None)


def encoder_fits(manifest: dict, model: str, dimension: int) -> bool:
    """Whether a query encoder may be used with an index: the same model by its last path part, and the same dimension."""
    last = lambda x: str(x).rstrip("/").rsplit("/", 1)[-1].casefold()
    return last(manifest.get("model", "")) == last(model) and int(manifest.get("dimension", -1)) == dimension


def pool_only(fused: DataFrame, limit: int) -> DataFrame:
    """(query, key, fusion) -> the first `limit` of each query, in fusion order, without diversity: a pool to ask about."""
    order = Window.partitionBy("query").orderBy(F.desc("fusion"), "key")
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def dense_only(scores: DataFrame, k: int) -> DataFrame:
    """(query, key, cosine) -> the k best by cosine alone; ratings have no say."""
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    return scores.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def positions(rows: DataFrame, **signals: str) -> DataFrame:
    """One list of candidates with its position by each signal, over all rows and among the eligible ones.

    A row without a signal has no position by it."""
    for name, column in signals.items():
        every = Window.partitionBy("query", F.col(column).isNull()).orderBy(F.desc(column), "key")
        some = Window.partitionBy("query", F.col(column).isNull(), "eligible").orderBy(F.desc(column), "key")
        rows = rows.withColumn(f"{name}_global", F.when(F.col(column).isNotNull(), F.row_number().over(every))).withColumn(
            f"{name}_eligible", F.when(F.col(column).isNotNull() & F.col("eligible"), F.row_number().over(some)))
    return rows


def prefix_and_tail(chosen: DataFrame, fused: DataFrame) -> DataFrame:
    """(query, key, position) and (query, key, fusion) -> every key: the chosen ones, then the others in fusion order."""
    size = chosen.groupBy("query").agg(F.max("position").alias("offset"))
    order = Window.partitionBy("query").orderBy(F.desc("fusion"), "key")
    tail = fused.join(chosen, ["query", "key"], "left_anti").join(size, "query", "left").withColumn(
        "position", (F.row_number().over(order) + F.coalesce("offset", F.lit(0))).cast("int"))
    return chosen.select("query", "key", "position").unionByName(tail.select("query", "key", "position"))


def violated_fields(asked: DataFrame, matched: DataFrame) -> DataFrame:
    """(query, attribute) and (query, asin, attribute) -> query, asin, score, matched, violated for every asin that
    matches something: violated are the asked fields that it does not match."""
    every = asked.groupBy("query").agg(F.array_sort(F.collect_set("attribute")).alias("asked"))
    weight = F.create_map(*[x for k, v in STRUCTURED_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    have = matched.distinct().groupBy("query", "asin").agg(
        F.sum(weight[F.col("attribute")]).alias("score"), F.array_sort(F.collect_set("attribute")).alias("matched"))
    return have.join(every, "query").select(
        "query", "asin", "score", F.array_join("matched", ",").alias("matched"), F.array_join(F.array_except("asked", "matched"), ",").alias("violated"))


def hold_or_recommend(turns: DataFrame, allow_wait: bool = True) -> DataFrame:
    """(session, turn, rank, probability, ask_attribute, progress) -> recommend and the reason, the first that applies.

    probability is that of a promotion; holding back is worth it above promotion_threshold, never twice in a row."""
    clear = F.coalesce(F.col("probability") > promotion_threshold(F.col("turn"), F.col("rank")), F.lit(False))
    would = F.lit(allow_wait) & (F.col("turn") < MAX_TURNS) & F.col("ask_attribute").isNotNull() & F.col("progress") & clear
    order = Window.partitionBy("session").orderBy("turn")
    # A run of turns that would wait alternates between waiting and not, from its first turn on.
    rows = turns.withColumn("would", would)
    starts = rows.withColumn("prior", F.coalesce(F.lag("would").over(order) & (F.lag("turn").over(order) == F.col("turn") - 1), F.lit(False)))
    runs = starts.withColumn("run", F.sum((~F.col("prior") | ~F.col("would")).cast("int")).over(order))
    inside = Window.partitionBy("session", "run").orderBy("turn")
    waits = F.col("would") & ((F.row_number().over(inside) % 2) == 1)
    reason = (
        F.when(F.lit(not allow_wait), "wait_disabled").when(F.col("turn") >= MAX_TURNS, "final_turn").when(F.col("ask_attribute").isNull(), "nothing_asked")
        .when(~F.col("progress"), "no_progress").when(F.col("would") & ~F.col("waits"), "waited_before")
        .when(F.col("rank").isNull() | F.col("probability").isNull(), "no_estimate").when(~clear, "below_threshold").otherwise("all_clear")
    )
    return runs.withColumn("waits", waits).withColumn("reason", reason).select("session", "turn", (~F.col("waits")).alias("recommend"), "reason")


def running_means(results: DataFrame, order: str = "session") -> DataFrame:
    """Sessions in order with the means of hit and reciprocal rank so far, as a progress line shows them."""
    so_far = Window.partitionBy("scenario").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reciprocal = F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))
    return results.withColumn("done", F.count("*").over(so_far)).withColumn("hit_rate", F.avg(F.col("hit").cast("double")).over(so_far)).withColumn(
        "mrr", F.avg(reciprocal).over(so_far))


def failure_counts(turns: DataFrame, results: DataFrame) -> DataFrame:
    """Missed sessions, turns that ended in an error and sessions that had one; tokens used in all."""
    bad: Column = F.col("error").isNotNull()
    counts = turns.agg(
        F.count_if(bad).alias("error_turns"), F.countDistinct(F.when(bad, F.col("session"))).alias("error_sessions"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return counts.crossJoin(results.agg(F.count_if(~F.col("hit")).alias("misses")))
