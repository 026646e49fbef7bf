"""Facet statistics and the choice of a clarifying question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns, weights of the session utility, priors of the modes, floors.
MAX_TURNS, MISS_TURN = 10, 11
MODE_PRIORS = {
    "BUYING": {"material": 1.00, "feature": 0.98, "color": 0.92, "size": 0.90, "style": 0.78, "use_case": 0.74, "brand": 0.68, "budget": 0.66, "category": 0.60},
    "BROWSING": {"style": 1.00, "use_case": 0.98, "feature": 0.96, "color": 0.92, "category": 0.90, "material": 0.84, "size": 0.76, "brand": 0.64, "budget": 0.62},
}
PRIOR_CEILING, SPLIT_FLOOR, BROAD_POOL = 0.90, 0.035, 50


def utility(turn: Column, rank: Column) -> Column:
    """Session value of a hit: .5 + .3 / rank + .2 (11 - turn) / 10; a miss is 0.

    .2 (11 - turn) is rounded once, as SQL's decimals are, so that ties are the same there and here."""
    return F.when(rank.isNull(), 0.0).otherwise(0.5 + 0.3 / rank + 2 * (MISS_TURN - turn) / 10 / 10)


def promotion_threshold(turn: Column, rank: Column) -> Column:
    return utility(turn, rank) / utility(turn + 1, F.lit(1))


def facet_mass(long: DataFrame, key: str = "asin") -> DataFrame:
    """(key, attribute, value) -> (attribute, value, mass): a product with k values gives each 1 / k."""
    rows = long.select(key, "attribute", "value").distinct()
    k = F.count("*").over(Window.partitionBy(key, "attribute"))
    return rows.withColumn("m", 1.0 / k).groupBy("attribute", "value").agg(F.sum("m").alias("mass"))


def facet_stats(long: DataFrame, pool: DataFrame, key: str = "asin") -> DataFrame:
    """Per attribute: values, coverage of the pool, Gini 1 - sum p^2, entropy in nats."""
    size = pool.agg(F.countDistinct(key).alias("pool"))
    covered = long.groupBy("attribute").agg(F.countDistinct(key).alias("covered"))
    mass = facet_mass(long, key)
    p = F.col("mass") / F.sum("mass").over(Window.partitionBy("attribute"))
    shape = mass.withColumn("p", p).groupBy("attribute").agg(
        F.count("*").alias("n_values"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy")
    )
    return shape.join(covered, "attribute").crossJoin(F.broadcast(size)).select(
        "attribute", "n_values", "pool", (F.col("covered") / F.col("pool")).alias("coverage"), "gini", "entropy"
    )


def top_values(mass: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("attribute").orderBy(F.desc("mass"), "value")
    return mass.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def split_score(stats: DataFrame) -> DataFrame:
    """coverage * gini * (.75 + .25 min(1, (values - 1) / 3)); null where the facet cannot split the pool."""
    s = F.col("coverage") * F.col("gini") * (0.75 + 0.25 * F.least(F.lit(1.0), (F.col("n_values") - 1) / 3.0))
    ok = (F.col("pool") >= 2) & (F.col("coverage") >= 0.20) & (F.col("n_values") >= 2) & (F.col("gini") >= 0.10)
    return stats.withColumn("split", F.when(ok, s))


def answer_probability(mode: str, attribute: Column, factor: Column | None = None) -> Column:
    """.90 of the mode's prior; a profile factor multiplies the odds, 0 vetoes."""
    prior = F.create_map(*[x for k, v in MODE_PRIORS[mode].items() for x in (F.lit(k), F.lit(v))])[attribute] * PRIOR_CEILING
    if factor is None:
        return prior
    odds = prior / (1 - prior) * factor
    return F.when(factor <= 0, 0.0).otherwise(odds / (1 + odds))


def question_utilities(stats: DataFrame, mode: str, turn: int, known: tuple[str, ...] = (), asked: tuple[str, ...] = ()) -> DataFrame:
    """Per attribute: split, answer probability, expected value and why it is not asked."""
    horizon = utility(F.lit(turn + 1), F.lit(1)) if turn < MAX_TURNS else F.lit(0.0)
    floor = SPLIT_FLOOR * PRIOR_CEILING * utility(F.lit(2), F.lit(1))
    rows = split_score(stats).withColumn("probability", answer_probability(mode, F.col("attribute")))
    rows = rows.withColumn("value", F.col("split") * F.col("probability") * horizon)
    none = lambda xs: F.col("attribute").isin(*xs) if xs else F.lit(False)
    reason = (
        F.when(F.col("pool") <= BROAD_POOL, "pool_not_broad").when(none(known), "known").when(none(asked), "asked")
        .when(F.col("split").isNull(), "no_split").when(F.col("probability").isNull(), "no_prior").when(F.col("value") < floor, "below_floor")
    )
    return rows.withColumn("reason", reason)


def choose_question(stats: DataFrame, mode: str, turn: int, known: tuple[str, ...] = (), asked: tuple[str, ...] = ()) -> DataFrame:
    """The attribute with the greatest value among those that may be asked; none gives no row."""
    order = list(MODE_PRIORS["BUYING"])
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("attribute")), F.lit(99))
    return question_utilities(stats, mode, turn, known, asked).where("reason is null").orderBy(F.desc("value"), rank).limit(1)


def question_text(top: DataFrame) -> DataFrame:
    """A question from the leading values of each attribute."""
    return top.groupBy("attribute").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("v")).select(
        "attribute", F.concat(F.lit("Which "), F.replace("attribute", F.lit("_"), F.lit(" ")), F.lit(" would you like: "),
                              F.array_join(F.transform("v", lambda x: x["value"]), ", "), F.lit("?")).alias("question"))


def profile_affinity(similarity: DataFrame) -> DataFrame:
    """(attribute, tag, similarity) -> (attribute, affinity, factor): best tag, rescaled over attributes; a flat profile is .5."""
    best = similarity.groupBy("attribute").agg(F.max("similarity").alias("best"))
    w = Window.partitionBy()
    span = F.max("best").over(w) - F.min("best").over(w)
    a = F.when(span < 1e-9, 0.5).otherwise((F.col("best") - F.min("best").over(w)) / span)
    return best.withColumn("affinity", a).withColumn("factor", 1 + 0.25 * (2 * F.col("affinity") - 1))
