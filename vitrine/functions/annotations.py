"""Normalising and validating annotation values, as Columns; a bad value gives a reason, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import snake_case

#: Other spellings of a value.
ALIASES = {
    "4 way stretch": "four way stretch", "high waist": "high waisted", "machine wash": "machine washable",
    "moisture wicking": "moisture wicking", "no show": "no show", "pull on": "pull on", "quick dry": "quick drying",
}
#: What a field must not hold.
INVALID = {
    "brand": ("classic", "hoodie", "leather", "premium", "running shoe", "sneaker", "waterproof", "women"),
    "color": ("color block", "floral", "graphic", "iridescent", "polka dot", "printed", "solid", "solid color", "striped"),
    "style": ("adult", "boys", "dress", "fashion sneaker", "girls", "jacket", "men", "professional", "shirt", "shoe", "toddler", "unisex", "women"),
    "feature": ("amazing", "best", "excellent", "high quality", "no closure", "premium", "stylish"),
    "use_case": (
        "all occasions", "casual wear", "daily life", "daily wear", "everyday use", "everyday wear", "general use", "general wear",
        "lifestyle", "normal wear"),
}
#: Size names, and words of measurements.
SIZES = ("2xl", "3xl", "large", "l", "medium", "m", "one size", "s", "small", "xl", "xs", "xxl")
MEASURES = (
    "centimeter", "centimeters", "cm", "dimension", "dimensions", "inch", "inches", "inseam", "measurement", "measurements", "meter",
    "meters", "mm", "package", "size", "weight")
#: Values that a model's list and a fact list may hold.
MODEL_LIMITS = {"brand": 3, "color": 3, "material": 4, "style": 6, "feature": 8, "use_case": 5}
FACT_LIMITS = {"category": 4, "color": 3, "material": 4, "size": 4, "style": 6, "feature": 8, "use_case": 5}


def _among(x: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False)) if values else F.lit(False)


def annotation_value(value: Column) -> Column:
    """Lower case, letters, digits and inner apostrophes; one space between words; aliases replaced."""
    x = F.regexp_replace(F.lower(value), "’", "'")
    x = F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}']+", " "))
    table = F.create_map(*[F.lit(y) for kv in ALIASES.items() for y in kv])
    return F.coalesce(F.try_element_at(table, x), x)


def natural_value(value: Column) -> Column:
    """Lower case with any apostrophe inside a word kept as '; every other mark is a space."""
    x = F.regexp_replace(F.lower(value), r"(?<=[\p{L}\p{N}])[’ʼ＇](?=[\p{L}\p{N}])", "'")
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}])'|'(?![\p{L}\p{N}])", " ")
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}']+", " "))


def display_value(value: Column) -> Column:
    """Lower case; underscores and hyphens are spaces; single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(value), "_-", "  "), r"\s+", " "))


def looks_like_size(value: Column) -> Column:
    """A size name, or a text with a word of measurement."""
    parts = F.split(value, " ")
    measures = F.array(*[F.lit(x) for x in MEASURES])
    sized = value.rlike("[0-9]") & (F.array_contains(parts, "size") | F.array_contains(parts, "sizing"))
    return _among(value, SIZES) | F.arrays_overlap(parts, measures) | sized


def is_invalid(field: str, value: Column) -> Column:
    bad = _among(value, INVALID.get(field, ()))
    return bad if field in ("brand", "color") else bad | looks_like_size(value)


def without_plain_stretch(values: Column) -> Column:
    """`stretch` and `stretchy` say nothing more where a special kind of stretch is listed."""
    plain = lambda v: v.isin("stretch", "stretchy")
    special = F.exists(values, lambda v: v.endswith(" stretch") & ~plain(v))
    return F.when(special, F.filter(values, lambda v: ~plain(v))).otherwise(values)


def model_list(field: str, values: Column) -> Column:
    """A model's list for a field: normalised, empty and invalid values dropped, first occurrences, at most the limit."""
    x = F.array_distinct(F.filter(F.transform(values, annotation_value), lambda v: (v != "") & ~is_invalid(field, v)))
    return F.slice(without_plain_stretch(x), 1, MODEL_LIMITS[field])


def fact_list(field: str, values: Column) -> Column:
    """A catalog fact list: snake case, empty values dropped, first occurrences, at most the limit."""
    x = F.array_distinct(F.filter(F.transform(values, snake_case), lambda v: v != ""))
    return F.slice(x, 1, FACT_LIMITS[field])


def list_problem(values: Column, most: int | None = None, overflow: str = "error") -> Column:
    """Why a strict attribute list is refused: null_value, blank, duplicate or too_many; null if it is fine.

    With overflow="truncate" a longer list is no problem; the caller cuts it."""
    x = F.transform(values, annotation_value)
    reason = (
        F.when(values.isNull(), "missing").when(F.exists(values, lambda v: v.isNull()), "null_value")
        .when(F.exists(x, lambda v: v == ""), "blank").when(F.size(F.array_distinct(x)) < F.size(x), "duplicate")
    )
    return reason if most is None or overflow == "truncate" else reason.when(F.size(x) > most, "too_many")


def reply_problem(reply: Column, keys: tuple[str, ...]) -> Column:
    """Why a model's JSON reply is refused: not_json, missing or unknown keys; null if it has exactly `keys`."""
    have = F.json_object_keys(reply)
    want = F.array(*[F.lit(k) for k in keys])
    return (
        F.when(have.isNull(), "not_json").when(F.size(F.array_except(want, have)) > 0, "missing_keys")
        .when(F.size(F.array_except(have, want)) > 0, "unknown_keys")
    )
