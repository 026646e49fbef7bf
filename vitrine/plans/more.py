"""More registered queries: semantic cleanup and lookup, annotation rules, query groups, ranking, contracts, routing with tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import semantic as S
from ..functions import text as T
from ..operators import contracts, dense, evaluate, facets, groups, ranking, registry, routing, semantic, session
from .bindings import FACETS, LONG, PRODUCTS, RESULTS, TURNS, products, table, turns
from .queries import _COS, _REG, _cosines, _hybrid, query

_CLEAN = f"""raw AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(lower(text), '[’ʼ＇]', '''', 'g'), '[\\p{{L}}\\p{{N}}]+(?:''+[\\p{{L}}\\p{{N}}]+)*') AS t FROM conversations),
clean AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(t, lambda w: w IN {S.SQL_NOT} OR w NOT IN {S.SQL_STOP}),
  lambda w: CASE WHEN w IN {S.SQL_NOT} THEN 'not' ELSE replace(w, '''', '') END), lambda w: w = 'not' OR w NOT IN {S.SQL_STOP}) AS t FROM raw)"""


@query(f"WITH {_CLEAN} SELECT conv_id, turn, array_to_string(t, ' ') AS cleaned, CAST(len(t) AS INTEGER) AS n FROM clean")
def q_semantic_cleanup(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", S.query_tokens(F.col("text")))
    return rows.select("conv_id", "turn", F.array_join("t", " ").alias("cleaned"), F.size("t").alias("n"))


@query(f"""WITH {_CLEAN}, g AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(t, list_concat(
  list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])))) AS gram FROM clean)
SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 5""")
def q_semantic_query_ngrams(spark, d):
    toks = table(spark, d, "conversations").select("conv_id", "turn", S.query_tokens(F.col("text")).alias("t"))
    grams = toks.select("conv_id", "turn", F.explode(T.all_ngrams(F.col("t"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 5")


_ATTRIBUTE = "['category', 'color', 'material', 'style', 'feature', 'use_case'][label % 6 + 1]"


def _values(spark, d):
    e = table(spark, d, "embeddings")
    attribute = F.element_at(F.array(*[F.lit(a) for a in semantic.ATTRIBUTES]), (F.col("label") % 6 + 1).cast("int"))
    return e.select(
        F.concat(attribute, F.lit(":"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("canonical_id"), attribute.alias("attribute"),
        (F.col("vec_id") % 40).alias("count"), "embedding")


def _scored(spark, d):
    q = table(spark, d, "embeddings").where("vec_id < 12").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return semantic.candidates(q, _values(spark, d))


_SCORED = f"""s AS (SELECT b.vec_id AS query, {_ATTRIBUTE.replace('label', 'a.label')} AS attribute, {_ATTRIBUTE.replace('label', 'a.label')} || ':' || lpad(a.vec_id::VARCHAR, 8, '0') AS canonical_id,
  {_COS} AS similarity FROM embeddings a, embeddings b WHERE b.vec_id < 12 AND a.vec_id % 40 >= 10)"""
_AORDER = "list_position(['category', 'color', 'material', 'style', 'feature', 'use_case'], attribute)"


@query(f"""WITH {_SCORED}, v AS (SELECT *, row_number() OVER (PARTITION BY query, attribute ORDER BY similarity DESC, canonical_id) AS place FROM s),
k AS (SELECT *, max(similarity) OVER (PARTITION BY query, attribute) AS best, max(similarity) FILTER (place = 2) OVER (PARTITION BY query, attribute) AS second FROM v WHERE place <= 3),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, {_AORDER}, canonical_id) AS rank FROM k WHERE best >= 0.25 AND similarity >= 0.25 AND (second IS NULL OR best - second >= 0.01))
SELECT query, CAST(rank AS INTEGER) AS rank, canonical_id, attribute, round(similarity, 6) AS similarity FROM f WHERE rank <= 3""")
def q_semantic_match_topk(spark, d):
    m = semantic.semantic_match(_scored(spark, d), 3, 0.25, 0.01)
    return m.select("query", "rank", "canonical_id", "attribute", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_SCORED}, o AS (SELECT *, query % 3 AS text_id FROM s WHERE similarity >= 0.25), b AS (SELECT text_id, attribute, canonical_id, max(similarity) AS similarity FROM o GROUP BY ALL)
SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY similarity DESC, {_AORDER}, canonical_id) AS INTEGER) AS rank, canonical_id, round(similarity, 6) AS similarity FROM b""")
def q_semantic_best_ngrams(spark, d):
    owner = table(spark, d, "embeddings").where("vec_id < 12").select(F.col("vec_id").alias("query"), (F.col("vec_id") % 3).alias("text_id"))
    m = semantic.best_of_ngrams(_scored(spark, d), owner, 0.25)
    return m.select("text_id", "rank", "canonical_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {PRODUCTS}, {LONG}, {_REG}, q AS (SELECT DISTINCT split_part(title, ' ', 1) AS surface FROM products UNION SELECT DISTINCT split_part(title, ' ', 2) || ' thing' FROM products),
e AS (SELECT surface, count(*) AS n, min(canonical_id) AS id FROM q JOIN reg ON normalized = lower(surface) GROUP BY surface)
SELECT surface, CASE WHEN n = 1 THEN id WHEN n IS NULL AND surface LIKE 'b%' THEN 'color:near' END AS canonical_id,
  CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' WHEN surface LIKE 'b%' THEN 'semantic' ELSE 'none' END AS method FROM q LEFT JOIN e USING (surface)""")
def q_exact_then_semantic(spark, d):
    p = products(spark, d)
    name = F.split("title", " ")
    said = p.select(name[0].alias("surface")).union(p.select(F.concat(name[1], F.lit(" thing")))).distinct()
    near = said.where("surface like 'b%'").select(F.col("surface").alias("query"), F.lit(1).alias("rank"), F.lit("color:near").alias("canonical_id"))
    return semantic.resolve(said, registry.build_registry(registry.unpivot(p, "asin", *FACETS)), near)


@query(f"""WITH {PRODUCTS}, {LONG}, r AS (SELECT DISTINCT attribute, trim(regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS normalized, asin FROM long)
SELECT attribute, normalized, array_to_string(list_sort(list(asin))[1:3], ',') AS asins FROM r GROUP BY attribute, normalized""")
def q_surface_examples(spark, d):
    e = semantic.examples(registry.unpivot(products(spark, d), "asin", *FACETS))
    return e.select("attribute", "normalized", F.array_join(F.transform("asins", lambda x: x.cast("string")), ",").alias("asins"))


_SIZED = ("CASE WHEN v IN ('2xl','3xl','large','l','medium','m','one size','s','small','xl','xs','xxl') OR list_has_any(string_split(v, ' '), "
          "['centimeter','centimeters','cm','dimension','dimensions','inch','inches','inseam','measurement','measurements','meter','meters','mm','package','size','weight']) "
          "OR (regexp_matches(v, '[0-9]') AND list_contains(string_split(v, ' '), 'sizing')) THEN true ELSE false END")


@query(f"""WITH t AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}'']+')) AS v FROM conversations)
SELECT v AS value, {_SIZED} AS sized, {_SIZED} OR v IN ('adult','boys','dress','fashion sneaker','girls','jacket','men','professional','shirt','shoe','toddler','unisex','women') AS bad_style FROM t WHERE v <> ''""")
def q_annotation_values(spark, d):
    v = table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}']+")).alias("value")).where("value <> ''").distinct()
    return v.select("value", A.looks_like_size(F.col("value")).alias("sized"), A.is_invalid("style", F.col("value")).alias("bad_style"))


@query(f"""WITH {TURNS}, {RESULTS}, o AS (SELECT session, min(turn) FILTER (override) AS o FROM turns GROUP BY session)
SELECT count(*) AS sessions, count(*) FILTER (h) AS hits FROM (SELECT t.session, coalesce(bool_or(hit AND turn <= 10 AND turn >= coalesce(o, 1)), false) AS h FROM turns t JOIN o USING (session) GROUP BY t.session)""")
def q_hits_after_override(spark, d):
    t = turns(spark, d)
    first = t.groupBy("session").agg(F.min(F.when(F.col("override"), F.col("turn"))).alias("override_turn"))
    r = evaluate.session_results(t.join(first, "session"))
    return r.agg(F.count("*").alias("sessions"), F.count_if("hit").alias("hits"))


@query(f"""WITH {TURNS}, {RESULTS} SELECT session, CAST(scenario AS INTEGER) AS scenario, count(*) OVER w AS done, round(avg(hit::INT) OVER w, 6) AS hit_rate, round(avg(coalesce(1.0 / best_rank, 0)) OVER w, 6) AS mrr
FROM results WINDOW w AS (PARTITION BY scenario ORDER BY session ROWS UNBOUNDED PRECEDING)""")
def q_running_means(spark, d):
    r = ranking.running_means(evaluate.session_results(turns(spark, d), "scenario"))
    return r.select("session", "scenario", "done", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {TURNS}, {RESULTS} SELECT count(*) FILTER (event_type = 'click') AS error_turns, count(DISTINCT session) FILTER (event_type = 'click') AS error_sessions,
  CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 7) AS BIGINT) AS completion_tokens, (SELECT count(*) FROM results WHERE NOT hit) AS misses FROM turns""")
def q_failures_and_usage(spark, d):
    t = turns(spark, d)
    rows = t.withColumn("error", F.when(F.col("event_type") == "click", "x")).withColumn("prompt_tokens", F.col("event_id") % 100).withColumn("completion_tokens", F.col("event_id") % 7)
    return ranking.failure_counts(rows, evaluate.session_results(t, "scenario"))


@query(f"""WITH {PRODUCTS}, {LONG}, c(query, attribute, value) AS (VALUES (1, 'color', 'red'), (1, 'category', 'bolt'), (1, 'style', 'ECONOMY')), m AS (SELECT DISTINCT query, asin, attribute FROM long JOIN c USING (attribute, value))
SELECT query, asin, round(sum(CASE attribute WHEN 'color' THEN 1.0 WHEN 'category' THEN 0.7 ELSE 0.5 END), 6)::DOUBLE AS score, string_agg(attribute, ',' ORDER BY attribute) AS matched,
  array_to_string(list_filter(['category', 'color', 'style'], lambda a: NOT list_contains(list(attribute), a)), ',') AS violated FROM m GROUP BY query, asin""")
def q_violated_fields(spark, d):
    c = spark.createDataFrame([(1, "color", "red"), (1, "category", "bolt"), (1, "style", "ECONOMY")], "query int, attribute string, value string")
    matched = registry.unpivot(products(spark, d), "asin", *FACETS).join(c, ["attribute", "value"]).select("query", "asin", "attribute")
    v = ranking.violated_fields(c.select("query", "attribute"), matched)
    return v.select("query", "asin", F.round("score", 6).alias("score"), "matched", "violated")


@query()
def q_rank_prefix_and_tail(spark, d):
    fused = _hybrid(spark, d)
    chosen = ranking.pool_only(fused, 10).select("query", "key", "position")
    return ranking.prefix_and_tail(chosen, fused)


@query(f"""WITH x AS (SELECT b.vec_id AS query, a.vec_id AS key, {_COS} AS cosine FROM embeddings a, embeddings b WHERE b.vec_id IN (3, 7))
SELECT query, key, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, key) AS INTEGER) AS dense_global,
  CAST(CASE WHEN key % 2 = 0 THEN row_number() OVER (PARTITION BY query, key % 2 = 0 ORDER BY cosine DESC, key) END AS INTEGER) AS dense_eligible FROM x""")
def q_debug_positions(spark, d):
    rows = _cosines(spark, d).withColumn("eligible", F.col("key") % 2 == 0)
    return ranking.positions(rows, dense="cosine").select("query", "key", "dense_global", "dense_eligible")


@query(f"""WITH {TURNS} SELECT session, turn, CASE WHEN session % 5 = 0 THEN 'ELIGIBLE' WHEN session % 5 = 1 THEN 'EXCLUDED_FROM_RECOMMENDATIONS'
  WHEN rank <= 3 AND (latency IS NULL OR latency < 40) THEN 'BUDGET_INELIGIBLE' WHEN session % 5 = 2 THEN 'NOT_IN_CATALOG' WHEN session % 5 = 3 THEN 'OUTSIDE_ELIGIBLE_FILTER' ELSE 'NOT_IN_RETRIEVAL_CANDIDATES' END AS status FROM turns""")
def q_target_status(spark, d):
    k = F.col("session") % 5
    rows = turns(spark, d).select(
        "session", "turn", (k == 0).alias("eligible"), (k == 1).alias("excluded"), F.col("latency").alias("price"),
        F.when(F.col("rank") <= 3, 40.0).alias("price_min"), F.lit(None).cast("double").alias("price_max"), (k != 2).alias("in_catalog"), (k == 3).alias("ranked"))
    return contracts.target_status(rows).select("session", "turn", "status")


@query(f"""WITH {PRODUCTS}, {LONG}, v AS (SELECT unnest(['color', 'category', 'brand', 'style']) AS attribute) SELECT attribute, n FROM (SELECT attribute, count(*) AS n FROM long GROUP BY attribute) JOIN v USING (attribute)""")
def q_natural_values(spark, d):
    long = registry.unpivot(products(spark, d), "asin", *FACETS)
    return long.where(A.natural_value(F.col("value")) == A.display_value(F.regexp_replace("value", "#", " "))).groupBy("attribute").agg(F.count("*").alias("n"))


@query()
def q_two_phase_intent(spark, d):
    rows = table(spark, d, "conversations").withColumn("fields", F.col("turn") % 5)
    out = routing.classify(rows, "text", tags=F.col("fields"))
    return out.select("conv_id", "turn", F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"), "intent", "tier")


@query()
def q_query_groups(spark, d):
    p = products(spark, d).where("color is not null")
    one = p.groupBy(F.col("category").alias("query")).agg(F.min("color").alias("c"), F.max("color").alias("x"))
    active = one.select("query", F.lit("color").alias("slot"), F.lit(0).alias("pos"), F.col("c").alias("value"))
    evidence = one.select("query", F.lit("color").alias("slot"), F.concat(F.lit("color:"), "x").alias("canonical_id"), F.concat("x", F.lit("ish")).alias("raw_text"), F.lit(0.95).alias("confidence"))
    g = groups.compile_groups(active, evidence, active.where("false"))
    return g.select("query", "slot", groups.expression(F.col("phrases"), F.col("columns")).alias("expression"))


@query()
def q_hold_or_recommend(spark, d):
    t = turns(spark, d).where("turn <= 10").select(
        "session", "turn", "rank", (F.col("event_id") % 11 / 10.0).alias("probability"),
        F.when(F.col("event_id") % 3 > 0, "color").alias("ask_attribute"), (F.col("event_id") % 4 > 0).alias("progress"))
    return ranking.hold_or_recommend(t)


__all__ = ["dense", "facets", "session", "T"]
