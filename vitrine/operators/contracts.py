"""Contracts of benchmark sessions and responses as tables of violations, and the status of a session's target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes that may be asked, turns at which an override may come, facts of a session, recommendations.
ASKABLE = ("budget", "brand", "size", "color", "material", "feature", "style", "use_case", "category", "other")
OVERRIDE_TURNS, FACTS, MOST_RECOMMENDED = (3, 4), (2, 4), 100


def _violations(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """(key, violation): the names of the rules that a row breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("violation"))


def session_violations(sessions: DataFrame, catalog: DataFrame, scenarios: dict[str, int] | None = None) -> DataFrame:
    """Sessions (sample_id, target_asin, scenario_type, hidden_facts array<struct<attribute, canonical, display>>,
    initial_message, initial_fact_id, override_turn, override_fact_id, override_message) -> (key, violation)."""
    ids = F.transform("hidden_facts", lambda f: F.concat_ws(":", f["attribute"], f["canonical"]))
    attributes = F.transform("hidden_facts", lambda f: f["attribute"])
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    override = F.col("scenario_type") == "intent_override"
    initial, late = F.col("initial_fact_id"), F.col("override_fact_id")
    head = lambda c: F.substring_index(c, ":", 1)
    rows = _violations(
        sessions, "sample_id",
        empty_id=blank("sample_id"), empty_target=blank("target_asin"), no_message=blank("initial_message"),
        facts_count=~F.coalesce(F.size("hidden_facts").between(*FACTS), F.lit(False)),
        repeated_fact=F.size(F.array_distinct(ids)) < F.size(ids),
        repeated_attribute=F.size(F.array_distinct(attributes)) < F.size(attributes),
        unsupported_attribute=F.exists(attributes, lambda a: ~a.isin(*[x for x in ASKABLE if x not in ("other", "category")])),
        no_display=F.exists("hidden_facts", lambda f: F.coalesce(F.trim(f["display"]), F.lit("")) == ""),
        initial_outside=initial.isNotNull() & ~F.array_contains(ids, initial),
        initial_disclosed=F.col("scenario_type").isin("browsing", "boundary") & initial.isNotNull(),
        initial_missing=F.col("scenario_type").isin("buying", "intent_override") & initial.isNull(),
        override_turn=override & ~F.coalesce(F.col("override_turn").isin(*OVERRIDE_TURNS), F.lit(False)),
        override_fact=override & (late.isNull() | ~F.array_contains(ids, late)),
        override_same=override & (head(late) == head(initial)),
        override_silent=override & blank("override_message"),
        override_stray=~override & (F.col("override_turn").isNotNull() | late.isNotNull() | F.col("override_message").isNotNull()),
    )
    for column, name in (("sample_id", "repeated_id"), ("target_asin", "repeated_target")):
        twice = sessions.groupBy(column).count().where("count > 1").select(column)
        rows = rows.unionByName(sessions.join(twice, column, "left_semi").select(F.col("sample_id").alias("key"), F.lit(name).alias("violation")))
    known = catalog.select(F.col("parent_asin").alias("target_asin"))
    rows = rows.unionByName(sessions.join(known, "target_asin", "left_anti").select(F.col("sample_id").alias("key"), F.lit("unknown_target").alias("violation")))
    if scenarios:
        want = F.create_map(*[F.lit(x) for kv in scenarios.items() for x in kv])
        have = sessions.groupBy("scenario_type").count()
        off = have.where(F.coalesce(F.try_element_at(want, F.col("scenario_type")), F.lit(0)) != F.col("count"))
        rows = rows.unionByName(off.select(F.col("scenario_type").alias("key"), F.lit("scenario_count").alias("violation")))
    return rows


def response_violations(responses: DataFrame) -> DataFrame:
    """(key, response: JSON text) -> (key, violation): keys, types, the asked attribute, recommendations and usage."""
    keys = F.json_object_keys("response")
    parsed = F.from_json("response", "message string, ask_attribute string, recommendations array<struct<parent_asin string, score double>>, usage map<string, string>")
    rows = responses.withColumn("keys", keys).withColumn("r", parsed)
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    usage = F.map_keys("r.usage")
    return _violations(
        rows, "key",
        not_an_object=F.col("keys").isNull(),
        missing_fields=F.size(F.array_except(names("message", "ask_attribute", "recommendations"), "keys")) > 0,
        unknown_fields=F.size(F.array_except("keys", names("message", "ask_attribute", "recommendations", "usage"))) > 0,
        message=F.array_contains("keys", "message") & F.col("r.message").isNull(),
        ask_attribute=F.col("r.ask_attribute").isNotNull() & ~F.col("r.ask_attribute").isin(*ASKABLE),
        recommendations=F.array_contains("keys", "recommendations") & F.col("r.recommendations").isNull(),
        too_many=F.size("r.recommendations") > MOST_RECOMMENDED,
        empty_asin=F.exists("r.recommendations", lambda x: F.coalesce(F.trim(x["parent_asin"]), F.lit("")) == ""),
        usage_fields=F.array_contains("keys", "usage") & (F.array_sort(usage) != names("completion_tokens", "prompt_tokens")),
        usage_values=F.exists(F.map_values("r.usage"), lambda v: ~v.rlike("^[0-9]+$")),
    )


def target_status(targets: DataFrame) -> DataFrame:
    """(session, eligible, excluded, price, price_min, price_max, in_catalog, ranked) -> status: the first that applies."""
    price, lo, hi = F.col("price"), F.col("price_min"), F.col("price_max")
    off = price.isNull() | F.coalesce(price < lo, F.lit(False)) | F.coalesce(price > hi, F.lit(False))
    return targets.withColumn(
        "status",
        F.when(F.col("eligible"), "ELIGIBLE").when(F.col("excluded"), "EXCLUDED_FROM_RECOMMENDATIONS")
        .when((lo.isNotNull() | hi.isNotNull()) & off, "BUDGET_INELIGIBLE").when(~F.col("in_catalog"), "NOT_IN_CATALOG")
        .when(F.col("ranked"), "OUTSIDE_ELIGIBLE_FILTER").otherwise("NOT_IN_RETRIEVAL_CANDIDATES"))


def session_order(sessions: DataFrame, seed: int, override_only: bool = False, limit: int | None = None) -> DataFrame:
    """Sessions in an order that the seed alone decides; a debugging run takes the first `limit`."""
    rows = sessions.where("scenario_type = 'intent_override'") if override_only else sessions
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "sample_id")).orderBy("place", "sample_id")
    return rows if limit is None else rows.limit(limit)
