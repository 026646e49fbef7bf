"""Scalar text, array and number functions as Columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TERM_CAP = 40
#: Fixed value: weights of summary n-grams by length.
NGRAM_WEIGHTS = (1.0, 2.0, 3.0)


def normalize_text(value: Column) -> Column:
    """Lower case; apostrophes inside a word go; any other run of marks is one space."""
    x = F.regexp_replace(F.lower(value), r"(?<=[\p{L}\p{N}])['’ʼ＇](?=[\p{L}\p{N}])", "")
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(StringType())
def fold_unicode(value: pd.Series) -> pd.Series:
    """NFKC and full case folding, which the built-in functions lack."""
    return value.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def canonical_id(attribute: Column, value: Column) -> Column:
    """attribute:value_with_underscores; null for a blank value."""
    n = normalize_text(value)
    return F.when(n != "", F.concat(attribute, F.lit(":"), F.replace(n, F.lit(" "), F.lit("_"))))


def canonical_value(identifier: Column) -> Column:
    return F.translate(F.regexp_replace(identifier, "^[^:]*:", ""), "_", " ")


def words(value: Column) -> Column:
    return F.filter(F.split(normalize_text(value), " "), lambda x: x != "")


def ngrams(array: Column, n: int) -> Column:
    """Contiguous n-grams joined by spaces, in order, repeats included."""
    return F.when(
        F.size(array) >= n, F.transform(F.sequence(F.lit(1), F.size(array) - n + 1), lambda i: F.array_join(F.slice(array, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def all_ngrams(array: Column, most: int = 3) -> Column:
    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), [ngrams(array, n) for n in range(1, most + 1)]))


def query_terms(value: Column, cap: int = TERM_CAP) -> Column:
    return F.slice(F.array_distinct(words(value)), 1, cap)


def weighted_ngrams(value: Column) -> Column:
    """struct(phrase, weight): unigrams 1, bigrams 2, trigrams 3, over the distinct terms."""
    terms = query_terms(value)

    def weighed(n: int, weight: float) -> Column:  # a lambda with a default would be taken for one of (value, index)
        return F.transform(F.array_distinct(ngrams(terms, n)), lambda p: F.struct(p.alias("phrase"), F.lit(weight).alias("weight")))

    parts = [weighed(n, w) for n, w in enumerate(NGRAM_WEIGHTS, 1)]
    return reduce(lambda a, b: F.concat(a, b), parts)


def distinct_values(array: Column) -> Column:
    """Normalised values, first occurrences in order, blanks dropped; a null list is empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(array, empty), normalize_text), lambda x: x != ""))


def snake_case(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def category_path(value: Column, levels: int = 4) -> Column:
    parts = F.array_distinct(F.filter(F.transform(F.split(value, ">"), snake_case), lambda x: x != ""))
    return F.slice(parts, F.greatest(F.size(parts) - levels + 1, F.lit(1)), levels)


def flatten_text(map_value: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(map_value), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


def first_number_price(value: Column) -> Column:
    """A finite non-negative number, else the first number in the text, else null ("1,299.99" gives 1)."""
    x = value.try_cast("double")
    found = F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1)
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(fine, F.when(x >= 0, x)).otherwise(F.when(found != "", found.try_cast("double")))


def strict_price(value: Column) -> Column:
    """Thousands separators, a leading "from" and one currency sign go; a dash is null; else null as well."""
    x = F.regexp_replace(F.trim(value), ",", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)^from\s+", ""), r"^[$£€]", "")
    return F.when(x.rlike(r"^\d+(\.\d+)?$"), x.try_cast("double"))


def rating(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when((x > 0) & ~F.isnan(x), x)


def normalized_rating(value: Column) -> Column:
    x = rating(value)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), x / 5)).otherwise(0.5)  # least() passes over nulls


def rating_weight(prior_rating: Column) -> Column:
    return F.when(prior_rating < 3.5, 0.15).otherwise(0.02)


def price_bucket(price: Column) -> Column:
    return (
        F.when(price < 25, "under_25").when(price < 50, "25_50").when(price < 100, "50_100").when(price < 200, "100_200")
        .when(price.isNotNull(), "200_plus")
    )


def rank_bucket(rank: Column) -> Column:
    return (
        F.when(rank.isNull(), "miss").when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= 5, "4-5").otherwise("6-10")
    )


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def product_card(title: Column, **attributes: Column) -> Column:
    """`title: ... | attribute: a, b` with empty parts left out."""
    parts = [F.when(title != "", F.concat(F.lit("title: "), title))]
    parts += [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}: "), F.array_join(v, ", "))) for k, v in attributes.items()]
    return F.concat_ws(" | ", *parts)


def lenient_json(value: Column, schema: str) -> Column:
    """The object between the first { and the last } of a model's reply."""
    return F.from_json(F.regexp_extract(value, r"(?s)(\{.*\})", 1), schema)


def clean_tags(tags: Column) -> Column:
    """Lower case, trimmed, first occurrences; a tag without a word is dropped."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(F.lower(t))), lambda t: t.rlike(r"[\p{L}\p{N}]")))


def lines_card(title: Column, **attributes: Column) -> Column:
    """`attribute: a, b` a line, the title last, empty parts left out."""
    parts = [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}: "), F.array_join(v, ", "))) for k, v in attributes.items()]
    return F.concat_ws("\n", *parts, F.when(title != "", F.concat(F.lit("title: "), title)))


def instructed(query: Column, instruction: str) -> Column:
    """A query as an instruction-tuned encoder wants it."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), query)


def changed_fields(before: Column, after: Column) -> Column:
    """Of two maps of text, the entries of the second that the first has not or has otherwise."""
    return F.map_filter(after, lambda k, v: ~F.coalesce(F.try_element_at(before, k).eqNullSafe(v), F.lit(False)))
