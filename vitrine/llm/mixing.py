"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Every document of a source is to be taken target / source_size times on average. The whole part is taken outright; the
fraction is rounded by the pivotal method: two units meet, word mass moves at random from one to the other until one of
them is integral, and the other goes on. The move keeps the pair's expected words and every unit's own expectation.
Units meet in a reduction tree: hashed blocks of about BLOCK units are folded side by side, each block passes its one
residual up, and the tree ends with one residual a source, which is rounded at random. So the words that a source gives
differ from its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, only, prepare, restored, uniform

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
BLOCK = 128
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """(source, size) -> (source, source_size, target), one row a source.

    Sources in code-point order, null last, weigh `weights` in turn. `share` of all words goes to them by weight; no
    target exceeds max_epochs times its source, and what is cut off is shared again by weight (water filling: with the
    sources ordered by capacity over weight, the first k are full for the least k whose level fits the next one)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    per = per.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    fill = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", F.when(level <= F.col("ratio"), level))
    return per.select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("w") * F.first("level", ignorenulls=True).over(
            fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col("cap"))).alias("target"),
    )


def _fold(level: int) -> Column:
    """Pivotal rounding along the array `units` of (id, a: words, p: fraction, u: random number).

    Gives struct(done: array of (id, bit), id, a, p): the decided units and the residual."""
    start = F.element_at("units", 1)
    zero = F.struct(
        F.expr("cast(array() as array<struct<id:struct<doc_id:bigint,size:bigint>,bit:int>>)").alias("done"),
        start["id"].alias("id"), start["a"].alias("a"), start["p"].alias("p"),
    )

    def meet(acc: Column, x: Column) -> Column:
        a, p, b, q = acc["a"], acc["p"], x["a"], x["p"]
        up = F.least((1 - p) * a, q * b)  # words that can move from x to the residual
        down = F.least(p * a, (1 - q) * b)
        rise = x["u"] * (up + down) < down
        # The one that becomes integral is decided: exactly 0 or 1, whatever rounding error the other carries.
        first = F.when(rise, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b)
        bit = F.when(rise == first, 1).otherwise(0)
        other_p = F.when(rise, F.when(first, q - up / b).otherwise(p + up / a)).otherwise(
            F.when(first, q + down / b).otherwise(p - down / a)
        )
        return F.struct(
            F.concat(acc["done"], F.array(F.struct(F.when(first, acc["id"]).otherwise(x["id"]).alias("id"), bit.alias("bit")))).alias("done"),
            F.when(first, x["id"]).otherwise(acc["id"]).alias("id"),
            F.when(first, b).otherwise(a).alias("a"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), other_p)).alias("p"),
        )

    return F.aggregate(F.slice("units", 2, F.size("units")), zero, meet)


def pivotal_rounding(units: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id: struct(doc_id, size), source, a: words > 0, p in (0, 1)) -> (source, id, bit); ids are distinct in a source.

    Each source's sum of a * bit differs from its sum of a * p by less than its largest a."""
    now, found, level = cut(units.select("id", "source", "a", "p")), None, 0
    while True:
        per = now.groupBy("source").agg(F.count("*").alias("n"))
        most = per.agg(F.max("n")).first()[0] or 0
        tree = now.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn(
            "block", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(level)), F.ceil(F.col("n") / F.lit(float(block))).cast("long"))
        )
        folded = cut(
            tree.groupBy("source", "block")
            .agg(F.sort_array(F.collect_list(F.struct(
                F.xxhash64("id", F.lit(seed + 1), F.lit(level)).alias("o"), "id", "a", "p",
                uniform(F.col("id"), F.lit(seed + 2), F.lit(level)).alias("u")))).alias("units"))
            .select("source", _fold(level).alias("r"))
        )
        done = folded.select("source", F.explode("r.done").alias("d")).select("source", "d.id", "d.bit")
        now = folded.select("source", "r.id", "r.a", "r.p")
        if most <= block // 2 or _one_each(now):
            last = now.select("source", "id", (uniform(F.col("id"), F.lit(seed + 3)) < F.col("p")).cast("int").alias("bit"))
            done = done.unionByName(last)
            return done if found is None else found.unionByName(done)
        found = done if found is None else found.unionByName(done)
        level += 1


def _one_each(now: DataFrame) -> bool:
    return now.groupBy("source").count().where("count > 1").isEmpty()


def _units(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, block: int, seed: int) -> DataFrame:
    """doc_id, source, size, m, source_size, target, whole, upper: the m rows that agree in the first three are taken
    `whole` times each, and `upper` of them once more."""
    prepare(docs.sparkSession)
    rows = only(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    units = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    targets = source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, max_epochs)
    targets = cut(targets.withColumnRenamed("source", "s"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        units.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("id", F.struct("doc_id", "size"))
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("mass", (ratio - F.floor(ratio)) * F.col("m"))
        .withColumn("extra", F.floor("mass").cast("long"))
        .withColumn("p", F.col("mass") - F.floor("mass"))
    )
    open_units = units.where("size > 0 and p > 0").select("id", "source", F.col("size").cast("double").alias("a"), "p")
    bits = pivotal_rounding(open_units, block, seed).select(
        F.col("id.doc_id").alias("d"), F.col("id.size").alias("z"), F.col("source").alias("s"), "bit"
    )
    out = units.join(
        bits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")) & F.col("source").eqNullSafe(F.col("s")), "left"
    )
    return out.select("doc_id", "source", "size", "m", "source_size", "target", "whole", (F.col("extra") + F.coalesce(F.col("bit"), F.lit(0))).alias("upper"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    max_epochs: float = MAX_EPOCHS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """Documents (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, copies, source: one row each.

    size counts words of the whole text (null and empty: 0). copies is how often the mix holds the document, at most
    ceil(max_epochs); taken = copies * size. A null source is a source of its own, last in order. A source without words
    has target 0. Rows that agree in doc_id, source and size are interchangeable: the whole part of their common share
    is dealt first and at most one of them is rounded. Null doc_ids are documents too. The result depends on the rows
    alone, so reruns agree. An empty table gives an empty result; other columns are ignored.
    """
    units = _units(docs, weights, share, max_epochs, block, seed)
    return (
        units.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
        .withColumn("copies", F.col("whole") + (F.col("nth") <= F.col("upper")).cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
    )


def repeat_to_mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    max_epochs: float = MAX_EPOCHS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """The documents as the mix holds them, with all their columns: a document that it takes twice is two rows, one that
    it leaves out is none.

    Rows that agree in doc_id, source and size share their copies: those with the least text hashes are taken once more.
    Of rows that agree in the text as well, one stands for all, as often as they are taken together. So the result
    depends on the rows alone, whatever their partitions."""
    units = cut(_units(docs, weights, share, max_epochs, block, seed).select(
        F.col("doc_id").alias("unit doc_id"), F.col("source").alias("unit source"), F.col("size").alias("unit size"), "m", "whole", "upper"))
    plain, at = numbered(docs)
    same = (
        F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("`unit doc_id`")) & F.col(at["source"]).eqNullSafe(F.col("`unit source`"))
        & (word_count(F.col(at["text"])) == F.col("`unit size`"))
    )
    every = [F.col(f"`{c}`") for c in plain.columns]

    def repeated(df: DataFrame, times: Column) -> DataFrame:
        held = df.withColumn("times", times).where("times > 0")
        return held.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*every)

    single = repeated(plain.join(units.where("m = 1"), same), F.col("whole") + F.col("upper"))
    # Units of several rows: their texts in order of hash, with the number of rows that have each.
    group = ["unit doc_id", "unit source", "unit size"]
    texts = plain.join(units.where("m > 1"), same).withColumn("text hash", F.xxhash64(at["text"])).groupBy(*group, "text hash").agg(
        F.count("*").alias("rows"), F.first("whole").alias("whole"), F.first("upper").alias("upper"), F.first(F.struct(*every)).alias("row"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("text hash")) - F.col("rows")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("rows"), F.col("upper") - before))
    shared = texts.withColumn("times", F.col("whole") * F.col("rows") + more).select(*[F.col(f"row.`{c}`").alias(c) for c in plain.columns], "times")
    return restored(single.unionByName(repeated(shared, F.col("times"))), docs)
