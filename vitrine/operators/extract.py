"""Constraint extraction: price bounds, sizes, dictionary phrases with longest-first choice."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

_N = r"\$? ?([0-9]+(?:\.[0-9]+)?)"
#: How bounds are worded (RE2-safe).
RANGE = rf"(?:between )?{_N} ?(?:-|to|and) ?{_N}"
MOST = rf"(?:under|below|less than|no more than|cheaper than|up to|within|at most) {_N}"
LEAST = rf"(?:over|above|more than|at least|starting at|from) {_N}"
AROUND = rf"(?:around|about|roughly|approximately) {_N}"
DIRECT = r"\$ ?([0-9]+(?:\.[0-9]+)?)"


def price_bounds(rows: DataFrame, message: str) -> DataFrame:
    """Adds price_min and price_max: a range (sorted), else bounds, else around +-20 %, else a plain amount as the most."""
    low = F.lower(F.col(message))
    get = lambda p, i=1: F.regexp_extract(low, p, i).try_cast("double")
    a, b, most, least, near, plain = get(RANGE, 1), get(RANGE, 2), get(MOST), get(LEAST), get(AROUND), get(DIRECT)
    ranged, bounded, about = b.isNotNull(), most.isNotNull() | least.isNotNull(), near.isNotNull()
    lo = F.when(ranged, F.least(a, b)).when(bounded, least).when(about, F.round(near * 0.8, 6))
    hi = F.when(ranged, F.greatest(a, b)).when(bounded, most).when(about, F.round(near * 1.2, 6)).otherwise(plain)
    return rows.withColumn("price_min", lo).withColumn("price_max", hi)


_SIZE = re.compile(
    r"(?P<range>\d+(?:\.\d+)?\s*(?:-|to)\s*\d+(?:\.\d+)?\s*(?:inches|inch|in|cm|mm|ft|oz|lb|kg)\b)"
    r"|(?P<dims>\d+(?:\.\d+)?\s*x\s*\d+(?:\.\d+)?(?:\s*x\s*\d+(?:\.\d+)?)?\s*(?:inches|inch|in|cm|mm)?)"
    r"|(?P<measure>\d+(?:\.\d+)?\s*(?:inches|inch|in|cm|mm|ft|oz|lb|kg)\b)"
    r"|(?P<numeric>\bsize\s+\d+(?:\.\d+)?\b)|(?P<label>\b(?:xx?s|small|medium|large|x{1,3}l|extra[ -]large)\b)", re.I)


def sizes(rows: DataFrame, key: str, message: str) -> DataFrame:
    """(key, kind, value, start, end): non-overlapping size expressions from the left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                [(k, m.lastgroup, re.sub(r"\s+", " ", m[0].lower()), m.start(), m.end()) for k, x in zip(b[key], b[message]) if x for m in _SIZE.finditer(x)],
                columns=["key", "kind", "value", "start", "end"])

    return rows.select(key, message).mapInPandas(run, f"key {rows.schema[key].dataType.simpleString()}, kind string, value string, start int, end int")


def phrase_spans(rows: DataFrame, key: str, message: str, phrases: DataFrame) -> DataFrame:
    """(key, start, n, phrase, attribute): dictionary phrases in a message's tokens, longest first, then leftmost.

    n-grams of the lengths that the dictionary has meet it by an equality join; a message's few spans are then chosen among."""
    phrases = phrases.select(F.col("normalized").alias("phrase"), "attribute")
    lengths = phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct()
    toks = rows.select(F.col(key).alias("key"), F.split(normalize_text(F.col(message)), " ").alias("t"))
    grams = toks.crossJoin(lengths).where("size(t) >= n").select(
        "key", "n", F.posexplode(F.expr("transform(sequence(1, size(t) - n + 1), i -> array_join(slice(t, i, n), ' '))")).alias("start", "phrase"))
    spans = grams.join(phrases, "phrase")
    order = F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("m"), "start", "phrase", "attribute")))
    chosen = F.expr(
        "aggregate(s, cast(array() as array<struct<m:int,start:int,phrase:string,attribute:string>>), (a, x) -> "
        "if(exists(a, y -> x.start < y.start - y.m and y.start < x.start - x.m and not (x.start = y.start and x.m = y.m)), a, concat(a, array(x))))")
    return spans.groupBy("key").agg(order.alias("s")).select("key", F.explode(chosen).alias("x")).select(
        "key", "x.start", (-F.col("x.m")).alias("n"), "x.phrase", "x.attribute")
