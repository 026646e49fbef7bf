"""Registered queries of the product-search engine, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, dense, evaluate, extract, facets, registry, retrieve, routing, session
from .bindings import FACETS, LONG, PRODUCTS, RESULTS, TURNS, products, table, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(spark, d):
    return registry.unpivot(products(spark, d), "asin", *FACETS)


def _rows(spark, schema: str, *rows):
    return spark.createDataFrame(list(rows), schema)


# ---- filters, joins, registry ----------------------------------------------------------------------------------

_NORM = "(CASE WHEN rating > 0 THEN least(1.0, rating / 5) ELSE 0.5 END)"


@query(f"WITH {PRODUCTS} SELECT asin, title, price, round(0.02 * {_NORM}, 6) AS score FROM products WHERE price >= 905 AND price <= 950 ORDER BY 0.02 * {_NORM} DESC, asin LIMIT 20")
def q_price_filter_topk(spark, d):
    rows = retrieve.eligible(products(spark, d), 905.0, 950.0)
    return retrieve.top_k(rows, retrieve.rating_bonus(None), 20).select("asin", "title", "price", F.round("score", 6).alias("score"))


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text")
def q_first_wins_dedupe(spark, d):
    return registry.first_wins(table(spark, d, "documents"), "source", "text", order_by="doc_id").select("doc_id", "source")


@query(f"WITH {PRODUCTS} SELECT p.asin, coalesce(f.brand, p.brand) AS brand, coalesce(f.price, p.price) AS price FROM products p LEFT JOIN (SELECT asin, upper(brand) AS brand, CASE WHEN asin % 2 = 0 THEN price + 1 END AS price FROM products WHERE asin % 3 = 0) f ON f.asin = p.asin")
def q_facts_left_join_coalesce(spark, d):
    p = products(spark, d)
    f = p.where("asin % 3 = 0").select("asin", F.upper("brand").alias("brand"), F.when(F.col("asin") % 2 == 0, F.col("price") + 1).alias("price"))
    return registry.facts_or_raw(p.select("asin", "brand", "price"), f, "asin", "brand", "price")


@query(f"WITH {PRODUCTS}, {LONG} SELECT p.asin, " + ", ".join(f"coalesce(max(value) FILTER (attribute = '{a}'), '') AS {a}" for a in FACETS) + ", count(l.value) AS n FROM products p LEFT JOIN long l ON l.asin = p.asin AND p.asin % 5 <> 0 GROUP BY p.asin")
def q_multi_attr_join(spark, d):
    p = products(spark, d)
    wide = registry.attribute_tables(p, registry.unpivot(p, "asin", *FACETS).where("asin % 5 <> 0"), FACETS)
    return wide.select("asin", *[F.array_join(a, ",").alias(a) for a in FACETS], sum((F.size(a) for a in FACETS), F.lit(0)).cast("long").alias("n"))


@query("SELECT DISTINCT o_custkey AS key, 'left_only' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'right_only' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_completeness_antijoin(spark, d):
    return registry.key_differences(
        table(spark, d, "orders").select(F.col("o_custkey").alias("key")), table(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key")


_REG = r"""reg AS (SELECT attribute, normalized, count(DISTINCT asin) AS count, min(value) AS value, count(DISTINCT value) AS variants,
  attribute || ':' || replace(normalized, ' ', '_') AS canonical_id
  FROM (SELECT *, trim(regexp_replace(lower(value), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized FROM long) GROUP BY attribute, normalized)"""


@query(f"WITH {PRODUCTS}, {LONG}, {_REG} SELECT * FROM reg")
def q_registry_build(spark, d):
    return registry.build_registry(_long(spark, d))


@query(f"WITH {PRODUCTS}, {LONG}, {_REG} SELECT normalized, count(DISTINCT attribute) AS attributes, string_agg(canonical_id, ',' ORDER BY canonical_id) AS ids FROM (SELECT attribute, normalized, canonical_id FROM reg UNION ALL SELECT 'tag', normalized, 'tag:' || replace(normalized, ' ', '_') FROM reg WHERE attribute IN ('color', 'category') AND count % 2 = 0) GROUP BY normalized HAVING count(DISTINCT attribute) > 1")
def q_ambiguous_surfaces(spark, d):
    reg = registry.build_registry(_long(spark, d)).select("attribute", "normalized", "canonical_id", "count")
    tags = reg.where("attribute in ('color', 'category') and count % 2 = 0").select(
        F.lit("tag").alias("attribute"), "normalized", F.concat(F.lit("tag:"), F.replace("normalized", F.lit(" "), F.lit("_"))).alias("canonical_id"))
    return registry.ambiguous_surfaces(reg.drop("count").unionByName(tags))


@query(r"WITH t AS (SELECT lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS value FROM documents), c AS (SELECT value, lang, count(*) AS n FROM t WHERE value <> '' GROUP BY value, lang), w AS (SELECT *, sum(n) OVER (PARTITION BY value) AS total, lead(n) OVER (PARTITION BY value ORDER BY n DESC, lang) AS second, row_number() OVER (PARTITION BY value ORDER BY n DESC, lang) AS r FROM c) SELECT value, lang, n, CAST(total AS BIGINT) AS total FROM w WHERE r = 1 AND n >= 0.75 * total AND (second IS NULL OR n >= 3 * second) AND n >= 20")
def q_frequency_dominance(spark, d):
    t = table(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("value")).where("value <> ''")
    counts = t.groupBy("value", "lang").agg(F.count("*").alias("n"))
    order = counts.withColumnRenamed("value", "token").withColumnRenamed("lang", "value")
    return registry.dominant(order, "token").where("n >= 20").select(F.col("token").alias("value"), F.col("value").alias("lang"), "n", "total")


@query(f"WITH {PRODUCTS}, {LONG} SELECT attribute, value, count(*) AS n, string_agg(asin, ',' ORDER BY asin) AS asins FROM long WHERE attribute IN ('color', 'style') GROUP BY attribute, value")
def q_inverted_index(spark, d):
    return _long(spark, d).where("attribute in ('color', 'style')").groupBy("attribute", "value").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("asin")), lambda x: x.cast("string")), ",").alias("asins"))


@query(f"WITH {PRODUCTS} SELECT asin FROM products WHERE color = 'red' AND style IN (SELECT min(style) FROM products) AND price <= 990")
def q_tag_intersection(spark, d):
    p = products(spark, d)
    style = p.agg(F.min("style")).first()[0]
    tagged = registry.with_all_tags(registry.unpivot(p, "asin", *FACETS), [("color", "red"), ("style", style)])
    return retrieve.eligible(p, None, 990.0).join(tagged, "asin", "left_semi").select("asin")


_CONS = "cons(query, attribute, value) AS (VALUES (1, 'color', 'red'), (1, 'color', 'blue'), (1, 'brand', 'Brand#12'), (2, 'style', 'ECONOMY'), (2, 'category', 'widget'))"


def _cons(spark):
    return _rows(spark, "query int, attribute string, value string", (1, "color", "red"), (1, "color", "blue"), (1, "brand", "Brand#12"), (2, "style", "ECONOMY"), (2, "category", "widget"))


@query(f"WITH {PRODUCTS}, {LONG}, {_CONS}, m AS (SELECT DISTINCT query, asin, attribute FROM long JOIN cons USING (attribute, value)) SELECT query, asin, round(sum(CASE attribute WHEN 'category' THEN 0.7 WHEN 'brand' THEN 7.0 WHEN 'color' THEN 1.0 WHEN 'style' THEN 0.5 END), 6) AS score, string_agg(attribute, ',' ORDER BY attribute) AS matched FROM m GROUP BY query, asin")
def q_structured_score(spark, d):
    s = registry.structured_scores(_long(spark, d), _cons(spark))
    return s.select("query", "asin", F.round("score", 6).alias("score"), "matched")


@query(f"WITH {PRODUCTS}, {LONG}, ev(query, attribute, value, similarity) AS (VALUES (1, 'color', 'red', 0.93), (1, 'color', 'red', 0.91), (1, 'color', 'green', NULL), (1, 'category', 'bolt', 1.7)), b AS (SELECT query, attribute, value, max(greatest(0, least(1, coalesce(similarity, 1.0)))) AS s FROM ev GROUP BY ALL) SELECT query, asin, CAST(round(sum(s), 6) AS DOUBLE) AS score FROM long JOIN b USING (attribute, value) GROUP BY query, asin")
def q_canonical_score(spark, d):
    ev = _rows(spark, "query int, attribute string, value string, similarity double", (1, "color", "red", 0.93), (1, "color", "red", 0.91), (1, "color", "green", None), (1, "category", "bolt", 1.7))
    return registry.canonical_scores(_long(spark, d), ev).select("query", "asin", F.round("score", 6).alias("score"))


# ---- lexical ---------------------------------------------------------------------------------------------------

_TOK = r"""tok AS (SELECT doc_id AS key, i, t[i] AS w, len(t) AS len FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '([\p{L}\p{N}])[''’ʼ＇]([\p{L}\p{N}])', '\1\2', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)))"""
_LEN = "lens AS (SELECT d.doc_id AS key, coalesce(max(len), 0) AS len FROM documents d LEFT JOIN tok ON tok.key = d.doc_id GROUP BY d.doc_id), st AS (SELECT count(*) AS docs, avg(len) AS mean FROM lens)"
_GRAM = "g AS (SELECT key, w AS phrase FROM tok UNION ALL SELECT a.key, a.w || ' ' || b.w FROM tok a JOIN tok b ON a.key = b.key AND b.i = a.i + 1 UNION ALL SELECT a.key, a.w || ' ' || b.w || ' ' || c.w FROM tok a JOIN tok b ON a.key = b.key AND b.i = a.i + 1 JOIN tok c ON a.key = c.key AND c.i = a.i + 2)"
_SCORE = """h AS (SELECT query, phrase, key, sum(weight) AS f FROM g JOIN ph USING (phrase) GROUP BY query, phrase, key),
df AS (SELECT query, phrase, count(*) AS n FROM h GROUP BY query, phrase),
sc AS (SELECT query, phrase, key, (CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END)
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM h JOIN df USING (query, phrase) JOIN lens USING (key), st)"""


@query(f"WITH {_TOK}, {_LEN}, {_GRAM}, ph(query, phrase, weight) AS (VALUES (1, 'the', 1.0), (1, 'of the', 1.0), (2, 'in de', 1.0), (2, 'und der', 1.0), (2, 'que', 1.0)), {_SCORE} SELECT query, key, round(sum(score), 6) AS score FROM sc GROUP BY query, key")
def q_bm25_phrase(spark, d):
    ph = _rows(spark, "query int, phrase string, column string, weight double", *[(q, p, "text", 1.0) for q, p in ((1, "the"), (1, "of the"), (2, "in de"), (2, "und der"), (2, "que"))])
    index = bm25.index_columns(table(spark, d, "documents"), "doc_id", "text")
    return bm25.bm25_search(index, ph).select("query", "key", F.round("score", 6).alias("score"))


_PTOK = r"""ptok AS (SELECT asin AS key, col, unnest(list_filter(string_split_regex(lower(v), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM (
  SELECT asin, 'title' AS col, title AS v FROM products UNION ALL SELECT asin, 'color', color FROM products UNION ALL SELECT asin, 'category', category FROM products
  UNION ALL SELECT asin, 'style', style FROM products)),
lens AS (SELECT key, count(*) AS len FROM ptok GROUP BY key), st AS (SELECT count(*) AS docs, avg(len) AS mean FROM lens),
slots(slot, phrase, col, weight) AS (VALUES ('color', 'red', 'color', 2.5), ('color', 'red', 'title', 6.0), ('category', 'bolt', 'category', 4.0), ('category', 'bolt', 'title', 6.0), ('style', 'economy', 'style', 6.0), ('style', 'economy', 'title', 6.0)),
h AS (SELECT slot, phrase, key, sum(weight) AS f FROM ptok JOIN slots ON slots.col = ptok.col AND slots.phrase = w GROUP BY slot, phrase, key),
df AS (SELECT slot, phrase, count(*) AS n FROM h GROUP BY slot, phrase),
sc AS (SELECT slot, key, sum((CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score
  FROM h JOIN df USING (slot, phrase) JOIN lens USING (key), st GROUP BY slot, key)"""


def _slot_scores(spark, d):
    index = bm25.index_columns(products(spark, d), "asin", "title", "color", "category", "style")
    rows = [(s, p, c, bm25.COLUMN_WEIGHTS[c]) for s, p in (("color", "red"), ("category", "bolt"), ("style", "economy")) for c in bm25.SLOT_COLUMNS[s] if c in ("title", s)]
    s = bm25.bm25_search(index, _rows(spark, "query string, phrase string, column string, weight double", *rows))
    return s.select(F.lit(1).alias("query"), F.col("query").alias("slot"), "key", "score")


@query(f"WITH {PRODUCTS}, {_PTOK} SELECT 1 AS query, key, round(sum(least(1.0, score / peak)) / (SELECT count(DISTINCT slot) FROM sc), 6) AS bm25 FROM (SELECT *, max(score) OVER (PARTITION BY slot) AS peak FROM sc) GROUP BY key")
def q_bm25_slot_fusion(spark, d):
    return bm25.slot_fusion(_slot_scores(spark, d)).select("query", "key", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {PRODUCTS}, {_PTOK} SELECT slot, count(*) AS matches, round(max(score), 6) AS peak FROM sc GROUP BY slot")
def q_bm25_explain(spark, d):
    return bm25.explain(_slot_scores(spark, d)).select("slot", "matches", F.round("peak", 6).alias("peak"))


@query(f"WITH {_TOK}, {_LEN}, {_GRAM}, ph(query, phrase, weight) AS (VALUES (1, 'the', 1.0), (1, 'that', 1.0), (1, 'with', 1.0), (1, 'the that', 1.0), (1, 'that with', 1.0), (1, 'the that with', 1.0)), {_SCORE} SELECT key, round(sum(score * (1 + len(phrase) - len(replace(phrase, ' ', '')))), 6) AS score FROM sc GROUP BY key")
def q_summary_ngram(spark, d):
    grams = spark.range(1).select(F.explode(T.weighted_ngrams(F.lit("The that, with the."))).alias("g")).select(
        F.lit(1).alias("query"), "g.phrase", F.lit("text").alias("column"), F.lit(1.0).alias("weight"), F.col("g.weight").alias("w"))
    index = bm25.index_columns(table(spark, d, "documents"), "doc_id", "text")
    s = bm25.bm25_phrases(index, grams.drop("w")).join(F.broadcast(grams.select("phrase", "w")), "phrase")
    return s.groupBy("key").agg(F.round(F.sum(F.col("score") * F.col("w")), 6).alias("score"))


@query(r"WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM conversations), g AS (SELECT conv_id, turn, unnest(t) AS gram FROM t UNION ALL SELECT conv_id, turn, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t) SELECT gram, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, gram FROM g) GROUP BY gram HAVING count(*) >= 5")
def q_semantic_ngrams(spark, d):
    toks = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)")).alias("t"))
    grams = toks.select("conv_id", "turn", F.explode(T.all_ngrams(F.col("t"), 2)).alias("gram")).distinct()
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 5")


@query(r"SELECT doc_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, list_distinct(t) AS u, t FROM (SELECT doc_id, (list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] ELSE '' END), lambda x: x <> ''))[1:40] AS t FROM (SELECT doc_id, (list_filter(string_split_regex(lower(source || ' ' || lang || ' ' || text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents)))")
def q_query_terms(spark, d):
    v = F.concat_ws(" ", "source", "lang", "text")
    t = table(spark, d, "documents").select("doc_id", T.query_terms(v).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


# ---- vectors, fusion -------------------------------------------------------------------------------------------

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"{_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _cosines(spark, d, queries="vec_id in (3, 7)"):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")
    q = table(spark, d, "embeddings").where(queries).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return dense.score_all(e, q)


@query(f"SELECT query, rank, key, round(cosine, 6) AS cosine FROM (SELECT b.vec_id AS query, a.vec_id AS key, {_COS} AS cosine, CAST(row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE b.vec_id IN (3, 7)) WHERE rank <= 20")
def q_cosine_topk(spark, d):
    return dense.ranked(_cosines(spark, d), "cosine", 20).select("query", "rank", "key", F.round("cosine", 6).alias("cosine"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v * (1 + vec_id % 7)) AS e FROM embeddings) SELECT a.vec_id AS key, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM x a, x b WHERE b.vec_id = 11")
def q_cosine_unnormalised(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda v: v.cast("double") * (1 + F.col("vec_id") % 7)).alias("embedding"))
    q = e.where("key = 11").select(F.col("key").alias("query"), F.col("embedding").alias("vector"))
    return dense.score_all(e, q).select("key", F.round("cosine", 6).alias("cosine"))


_VIEWS = {"categories": 1.5, "title": 2.0, "features": 1.25, "description": 0.75}


@query("WITH v AS (SELECT vec_id, k, list_slice(embedding::DOUBLE[], k * 16 + 1, k * 16 + 16) AS e FROM embeddings, range(0, 4) t(k)), s AS (SELECT a.vec_id AS key, a.k, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c, [1.5, 2.0, 1.25, 0.75][a.k + 1] AS w FROM v a JOIN v b ON a.k = b.k AND b.vec_id = 5 WHERE a.vec_id % 5 <> a.k) SELECT key, CAST(round(sum(w * c) / sum(w), 6) AS DOUBLE) AS score FROM s GROUP BY key")
def q_multi_view_cosine(spark, d):
    e = table(spark, d, "embeddings")
    parts = []
    for k, view in enumerate(_VIEWS):
        v = e.select(F.col("vec_id").alias("key"), F.slice("embedding", 16 * k + 1, 16).alias("embedding"))
        q = v.where("key = 5").select(F.col("key").alias("query"), F.col("embedding").alias("vector"))
        parts.append(dense.score_all(v, q).withColumn("view", F.lit(view)).withColumn("present", F.col("key") % 5 != k))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return dense.multi_view(scores, _VIEWS).select("key", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT b.vec_id AS query, a.vec_id AS key, {_COS} AS cosine FROM embeddings a JOIN (SELECT label, count(*) AS count FROM embeddings GROUP BY label) c USING (label), embeddings b WHERE b.vec_id < 20 AND a.vec_id <> b.vec_id AND c.count >= 10), w AS (SELECT *, lead(cosine) OVER (PARTITION BY query ORDER BY cosine DESC, key) AS second, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, key) AS r FROM s) SELECT query, key, round(cosine, 6) AS cosine FROM w WHERE r = 1 AND cosine >= 0.3 AND cosine - second >= 0.005")
def q_semantic_match_guarded(spark, d):
    counts = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("count"))
    keyed = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label").join(counts, "label")
    s = _cosines(spark, d, "vec_id < 20").where("key <> query").join(keyed, "key")
    return dense.guarded_match(s, 0.3, 0.005).select("query", "key", F.round("cosine", 6).alias("cosine"))


def _hybrid(spark, d):
    vec = dense.ranked(_cosines(spark, d, "vec_id = 3").select(F.lit(1).alias("query"), "key", "cosine"), "cosine", dense.ARM)
    ph = _rows(spark, "query int, phrase string, column string, weight double", (1, "the", "text", 1.0), (1, "that", "text", 1.0))
    lex = dense.ranked(bm25.bm25_search(bm25.index_columns(table(spark, d, "documents"), "doc_id", "text"), ph), "score", dense.ARM, positive_only=True)
    return dense.reciprocal_rank_fusion(vec, lex)


@query(f"WITH {_TOK}, {_LEN}, g AS (SELECT key, w AS phrase FROM tok), ph(query, phrase, weight) AS (VALUES (1, 'the', 1.0), (1, 'that', 1.0)), {_SCORE}, b AS (SELECT key, sum(score) AS s FROM sc GROUP BY key), r AS (SELECT key, row_number() OVER (ORDER BY s DESC, key) AS rank FROM b WHERE s > 0 UNION ALL SELECT a.vec_id, row_number() OVER (ORDER BY {_COS} DESC, a.vec_id) FROM embeddings a, embeddings b WHERE b.vec_id = 3) SELECT key, round(sum(1.0 / (60 + rank)), 6) AS fusion FROM r WHERE rank <= 100 GROUP BY key")
def q_rrf_hybrid(spark, d):
    return _hybrid(spark, d).select("key", F.round("fusion", 6).alias("fusion"))


@query()
def q_mmr(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    pool = _cosines(spark, d, "vec_id in (3, 7)").withColumnRenamed("cosine", "fusion").join(e, "key").withColumn("bonus", F.lit(0.0))
    return dense.mmr(pool, 10).select("query", "key", "position", F.round("mmr", 6).alias("mmr"))


@query(f"WITH {PRODUCTS} SELECT asin, round(0.15 * {_NORM}, 6) AS critical, round(0.02 * {_NORM}, 6) AS ordinary, row_number() OVER (ORDER BY 0.15 * {_NORM} DESC, asin) AS position FROM products WHERE color = 'red'")
def q_rating_tiebreak(spark, d):
    p = products(spark, d).where("color = 'red'")
    crit, ordinary = retrieve.rating_bonus(2.5), retrieve.rating_bonus(4.5)
    order = Window.orderBy(F.desc(crit), "asin")
    return p.select("asin", F.round(crit, 6).alias("critical"), F.round(ordinary, 6).alias("ordinary"), F.row_number().over(order).cast("long").alias("position"))


@query(f"WITH {PRODUCTS}, a AS (SELECT asin, row_number() OVER (ORDER BY price DESC, asin) AS pos FROM products WHERE color = 'red' AND price IS NOT NULL), b AS (SELECT asin, row_number() OVER (ORDER BY {_NORM} DESC, asin) AS pos FROM products), u AS (SELECT asin, pos, 0 AS src FROM a WHERE pos <= 6 UNION ALL SELECT asin, pos, 1 FROM b WHERE pos <= 50) SELECT asin, min(src) AS src FROM u GROUP BY asin ORDER BY min(src * 1000 + pos), asin LIMIT 10")
def q_backfill_topk(spark, d):
    p = products(spark, d)
    a = p.where("color = 'red' and price is not null").select("asin", F.row_number().over(Window.orderBy(F.desc("price"), "asin")).alias("pos")).where("pos <= 6")
    b = p.select("asin", F.row_number().over(Window.orderBy(F.desc(T.normalized_rating(F.col("rating").cast("string"))), "asin")).alias("pos")).where("pos <= 50")
    return retrieve.fill_to_k(a, b, 10).select("asin", "src")


@query(f"""WITH {TURNS}, {PRODUCTS}, g AS (SELECT *, sum(override::INT) OVER (PARTITION BY session ORDER BY turn) AS segment FROM turns),
l AS (SELECT session, max(segment) AS segment FROM g GROUP BY session),
shown AS (SELECT DISTINCT session, event_id % 2000 + 1 AS asin FROM g JOIN l USING (session, segment)),
n AS (SELECT session, count(*) AS n FROM shown WHERE asin IN (SELECT asin FROM products) GROUP BY session)
SELECT session, (SELECT count(*) FROM products) - coalesce(n, 0) AS eligible FROM l LEFT JOIN n USING (session)""")
def q_exclusion_antijoin(spark, d):
    g = session.goal_segments(turns(spark, d))
    last = g.groupBy("session").agg(F.max("segment").alias("segment"))
    shown = g.join(last, ["session", "segment"]).select("session", (F.col("event_id") % 2000 + 1).alias("asin"))
    return retrieve.eligible_counts(last.select("session"), shown, products(spark, d))


# ---- facets and clarification ----------------------------------------------------------------------------------

_STATS = """mass AS (SELECT attribute, value, sum(1.0 / k) AS mass FROM (SELECT *, count(*) OVER (PARTITION BY asin, attribute) AS k FROM (SELECT DISTINCT * FROM long)) GROUP BY attribute, value),
stats AS (SELECT attribute, count(*) AS n_values, (SELECT count(*) FROM products) AS pool, (SELECT count(DISTINCT asin) FROM long l WHERE l.attribute = m.attribute) / (SELECT count(*) FROM products) AS coverage,
  1 - sum(p * p) AS gini, -sum(p * ln(p)) AS entropy FROM (SELECT *, mass / sum(mass) OVER (PARTITION BY attribute) AS p FROM mass) m GROUP BY attribute)"""
_MULTI = LONG[:-1] + " UNION ALL SELECT asin, 'style', 'EXTRA' FROM products WHERE asin % 4 = 0)"


def _multi(spark, d):
    p = products(spark, d)
    return p, registry.unpivot(p, "asin", *FACETS).unionByName(p.where("asin % 4 = 0").select("asin", F.lit("style").alias("attribute"), F.lit("EXTRA").alias("value")))


@query(f"WITH {PRODUCTS}, {_MULTI}, {_STATS} SELECT attribute, n_values, pool, round(coverage, 6) AS coverage, CAST(round(gini, 6) AS DOUBLE) AS gini, round(entropy, 6) AS entropy FROM stats")
def q_facet_stats(spark, d):
    p, long = _multi(spark, d)
    s = facets.facet_stats(long, p)
    return s.select("attribute", "n_values", "pool", *[F.round(c, 6).alias(c) for c in ("coverage", "gini", "entropy")])


@query(f"WITH {PRODUCTS}, {_MULTI}, {_STATS} SELECT attribute, value, CAST(round(mass, 6) AS DOUBLE) AS mass, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY attribute ORDER BY mass DESC, value) AS INTEGER) AS rank FROM mass) WHERE rank <= 3")
def q_facet_top_values(spark, d):
    t = facets.top_values(facets.facet_mass(_multi(spark, d)[1]))
    return t.select("attribute", "value", F.round("mass", 6).alias("mass"), "rank")


@query(f"WITH {PRODUCTS} SELECT CASE WHEN price < 25 THEN 'under_25' WHEN price < 50 THEN '25_50' WHEN price < 100 THEN '50_100' WHEN price < 200 THEN '100_200' WHEN price IS NOT NULL THEN '200_plus' END AS bucket, count(*) AS n FROM (SELECT (price - 890) * 2 AS price FROM products) GROUP BY 1")
def q_price_buckets(spark, d):
    return products(spark, d).groupBy(T.price_bucket((F.col("price") - 890) * 2).alias("bucket")).agg(F.count("*").alias("n"))


_SPLIT = "CASE WHEN pool >= 2 AND coverage >= 0.2 AND n_values >= 2 AND gini >= 0.1 THEN coverage * gini * (0.75 + 0.25 * least(1.0, (n_values - 1) / 3.0)) END"


@query(f"WITH {PRODUCTS}, {_MULTI}, {_STATS}, v AS (SELECT attribute, {_SPLIT} * 0.9 * CASE attribute WHEN 'style' THEN 1.0 WHEN 'color' THEN 0.92 WHEN 'category' THEN 0.9 WHEN 'brand' THEN 0.64 END * (0.5 + 0.3 + 0.2 * (11 - 3) / 10) AS value FROM stats WHERE attribute <> 'brand') SELECT attribute, CAST(round(value, 6) AS DOUBLE) AS value FROM v WHERE value >= 0.035 * 0.9 * 0.98 ORDER BY value DESC LIMIT 1")
def q_clarify_choose(spark, d):
    p, long = _multi(spark, d)
    return facets.choose_question(facets.facet_stats(long, p), "BROWSING", 2, known=("brand",)).select("attribute", F.round("value", 6).alias("value"))


@query()
def q_clarify_question(spark, d):
    return facets.question_text(facets.top_values(facets.facet_mass(_long(spark, d))))


@query("WITH s(attribute, similarity) AS (VALUES ('color', 2 / 3), ('color', 0.0), ('style', 1 / 4), ('style', 1 / 3), ('brand', 0.0), ('brand', 0.0)), b AS (SELECT attribute, max(similarity) AS best FROM s GROUP BY attribute) SELECT attribute, CAST(round((best - (SELECT min(best) FROM b)) / ((SELECT max(best) FROM b) - (SELECT min(best) FROM b)), 6) AS DOUBLE) AS affinity, CAST(round(1 + 0.25 * (2 * (best - (SELECT min(best) FROM b)) / ((SELECT max(best) FROM b) - (SELECT min(best) FROM b)) - 1), 6) AS DOUBLE) AS factor FROM b")
def q_profile_affinity(spark, d):
    tags = _rows(spark, "tag string", ("bold color",), ("slim fit style",))
    gloss = _rows(spark, "attribute string, gloss string", ("color", "bold bright color"), ("style", "style"), ("brand", "maker"))
    both = gloss.crossJoin(F.broadcast(tags))  # a profile's few tags against the fixed list of attributes
    s = both.select("attribute", "tag", T.jaccard(T.words(F.col("gloss")), T.words(F.col("tag"))).alias("similarity"))
    fixed = s.withColumn("similarity", F.when((F.col("attribute") == "style") & (F.col("tag") == "bold color"), 0.25).otherwise(F.col("similarity")))
    return facets.profile_affinity(fixed).select("attribute", F.round("affinity", 6).alias("affinity"), F.round("factor", 6).alias("factor"))


# ---- evaluation ------------------------------------------------------------------------------------------------

@query(f"WITH {TURNS}, v AS (SELECT session, turn, CASE WHEN hit AND turn <= 10 THEN 0.5 + 0.3 / rank + 0.2 * (11 - turn) / 10 END AS v FROM turns), s AS (SELECT session, coalesce(arg_min(v, turn) FILTER (v IS NOT NULL), 0) AS greedy, coalesce(max(v), 0) AS oracle FROM v GROUP BY session) SELECT CAST(round(avg(greedy), 6) AS DOUBLE) AS greedy, CAST(round(avg(oracle), 6) AS DOUBLE) AS oracle, CAST(round(avg(oracle - greedy), 6) AS DOUBLE) AS upside, count(*) FILTER (oracle > greedy) AS improved FROM s")
def q_session_utility(spark, d):
    return evaluate.value_upside(evaluate.session_values(turns(spark, d)))


_METRIC = """count(*) AS sessions, round(avg(hit::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / best_rank, 0)), 6) AS mrr, round(avg(coalesce(first_turn, 11)), 6) AS mttc,
  round(greatest(0, least(1, (11 - avg(coalesce(first_turn, 11))) / 10)), 6) AS efficiency,
  round(0.5 * avg(hit::INT) + 0.3 * avg(coalesce(1.0 / best_rank, 0)) + 0.2 * greatest(0, least(1, (11 - avg(coalesce(first_turn, 11))) / 10)), 6) AS technical"""


@query(f"WITH {TURNS}, {RESULTS} SELECT {_METRIC} FROM results")
def q_metrics_overall(spark, d):
    return evaluate.metrics(evaluate.session_results(turns(spark, d), "scenario"))


@query(f"WITH {TURNS}, {RESULTS} SELECT CAST(scenario AS INTEGER) AS scenario, {_METRIC} FROM results GROUP BY GROUPING SETS ((scenario), ())")
def q_metrics_by_scenario(spark, d):
    return evaluate.metrics_by_scenario(evaluate.session_results(turns(spark, d), "scenario"))


@query(f"WITH {TURNS}, {RESULTS}, s AS (SELECT turn, count(DISTINCT session) AS samples, avg(latency) AS l FROM turns GROUP BY turn), h AS (SELECT first_turn AS turn, count(*) AS n FROM results WHERE hit GROUP BY first_turn) SELECT CAST(t.turn AS INTEGER) AS turn, coalesce(samples, 0) AS samples, coalesce(h.n, 0) AS turn_hits, CAST(sum(coalesce(h.n, 0)) OVER (ORDER BY t.turn) AS BIGINT) AS cumulative_hits, round(sum(coalesce(h.n, 0)) OVER (ORDER BY t.turn) / (SELECT count(*) FROM results), 6) AS cumulative_rate, round(l, 6) AS mean_latency FROM range(1, 11) t(turn) LEFT JOIN s ON s.turn = t.turn LEFT JOIN h ON h.turn = t.turn")
def q_turn_curve(spark, d):
    t = turns(spark, d)
    return evaluate.turn_curve(evaluate.session_results(t, "scenario"), t)


@query(f"WITH {TURNS}, {RESULTS} SELECT CASE WHEN best_rank IS NULL THEN 'miss' WHEN best_rank = 1 THEN '1' WHEN best_rank <= 3 THEN '2-3' WHEN best_rank <= 5 THEN '4-5' ELSE '6-10' END AS bucket, count(*) AS n FROM results GROUP BY 1")
def q_rank_histogram(spark, d):
    return evaluate.rank_histogram(evaluate.session_results(turns(spark, d), "scenario"))


@query("SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def q_latency_percentiles(spark, d):
    return evaluate.latency_percentiles(table(spark, d, "events"), "value", "event_type")


@query(f"WITH {TURNS}, x AS (SELECT *, latency - lag(latency) OVER (PARTITION BY session ORDER BY turn) AS delta FROM turns) SELECT CASE WHEN event_type IN ('click', 'view') THEN 'look' ELSE 'act' END AS family, count(*) AS changes, round(sum(delta), 4) AS delta FROM x WHERE delta > 0 GROUP BY 1")
def q_counter_deltas(spark, d):
    family = F.when(F.col("event_type").rlike("^(click|view)$"), "look").otherwise("act")
    return evaluate.counter_deltas(turns(spark, d), "session", "turn", "latency", family)


@query(f"WITH {TURNS}, x AS (SELECT rank, lead(rank) OVER (PARTITION BY session ORDER BY turn) AS nx FROM turns) SELECT CAST(rank AS INTEGER) AS rank, count(*) AS observations, round(avg((nx = 1)::INT), 6) AS p_first, round(avg((nx < rank)::INT), 6) AS p_better FROM x WHERE nx IS NOT NULL GROUP BY rank")
def q_promotion_stats(spark, d):
    return evaluate.promotion_stats(turns(spark, d))


def _judged(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("gold"), F.col("toxic").alias("predicted"))


@query("WITH c AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS a, " + ", ".join(f"2.0 * count(*) FILTER (quality = {k} AND toxic = {k}) / (count(*) FILTER (quality = {k}) + count(*) FILTER (toxic = {k})) AS f{k}" for k in (0, 1)) + " FROM labels) SELECT n, round(a, 6) AS accuracy, round((f0 + f1) / 2, 6) AS macro_f1 FROM c")
def q_macro_f1(spark, d):
    return evaluate.macro_f1(_judged(spark, d))


@query("WITH c AS (SELECT 0.5 + (doc_id % 50) / 100.0 AS c, quality FROM labels) SELECT CASE WHEN c < 0.6 THEN '0.50-0.60' WHEN c < 0.7 THEN '0.60-0.70' WHEN c < 0.85 THEN '0.70-0.85' ELSE '0.85-1.00' END AS bucket, count(*) AS n, round(avg(quality), 6) AS accuracy FROM c GROUP BY 1")
def q_calibration(spark, d):
    rows = table(spark, d, "labels").select((0.5 + (F.col("doc_id") % 50) / 100.0).alias("confidence"), F.col("quality").alias("correct"))
    return evaluate.calibration(rows)


@query("WITH s AS (SELECT quality AS gold, (doc_id % 100) / 100.0 AS score FROM labels) SELECT CAST(t AS DOUBLE) AS threshold, round(avg(((score >= t)::INT = gold)::INT), 6) AS accuracy, count(*) FILTER (score >= t) AS positive FROM s, (VALUES (0.25), (0.5), (0.75)) v(t) GROUP BY t")
def q_threshold_sweep(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("gold"), ((F.col("doc_id") % 100) / 100.0).alias("score"))
    return evaluate.threshold_sweep(rows, [0.25, 0.5, 0.75])


# ---- sessions, routing, extraction -----------------------------------------------------------------------------

@query(f"WITH {TURNS}, g AS (SELECT *, sum(override::INT) OVER (PARTITION BY session ORDER BY turn) AS segment FROM turns) SELECT session, CAST(segment AS BIGINT) AS segment, max(CASE WHEN rank <= 3 THEN latency END) AS price_min, min(CASE WHEN rank >= 8 THEN latency END) AS price_max, count(*) AS turns FROM g GROUP BY session, segment")
def q_goal_segments(spark, d):
    t = turns(spark, d).withColumn("price_min", F.when(F.col("rank") <= 3, F.col("latency"))).withColumn("price_max", F.when(F.col("rank") >= 8, F.col("latency")))
    return session.segment_bounds(t)


def _ledger_sql() -> str:
    says = lambda x: f"regexp_matches(t, '{x.regex.replace(chr(39), chr(39) * 2)}')" if x.patterns else "false"
    hit = {x.name: says(x) for x in routing.SIGNALS}
    hard = " OR ".join(hit[x.name] for x in routing.SIGNALS if x.hard)
    buying = " OR ".join(hit[x.name] for x in routing.SIGNALS if x.side > 0 and not x.needs_buying)
    for x in routing.SIGNALS:
        if x.needs_buying:
            hit[x.name] = f"({hit[x.name]} AND ({buying}))"
        if x.yields_to_hard:
            hit[x.name] = f"({hit[x.name]} AND NOT ({hard}))"
    side = lambda k: " + ".join(f"{x.weight} * ({hit[x.name]})::INT" for x in routing.SIGNALS if x.side == k)
    filler = ", ".join(f"'{w}'" for w in routing.FILLER)
    return f"""WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
m AS (SELECT conv_id, turn, len(list_filter(regexp_extract_all(t, '[a-z0-9'']+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g') NOT IN ({filler}))) = 0 AS empty,
  0.35 + 1.25 * ({side(1)}) - 1.15 * ({side(-1)}) AS margin FROM c),
p AS (SELECT *, greatest(0.5, least(0.99, 1 / (1 + exp(-1.6 * abs(margin))))) AS confidence FROM m)
SELECT conv_id, turn, CAST(round(CASE WHEN empty THEN 0 ELSE margin END, 6) AS DOUBLE) AS margin, CAST(round(CASE WHEN empty THEN 0.55 ELSE confidence END, 6) AS DOUBLE) AS confidence,
  CASE WHEN empty OR margin < 0 THEN 'BROWSING' ELSE 'BUYING' END AS intent FROM p"""


@query(_ledger_sql())
def q_intent_ledger(spark, d):
    rows = routing.classify(table(spark, d, "conversations"), "text")
    return rows.select("conv_id", "turn", F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"), "intent")


_SAID = ("under $50 please", "between 20 and 35 dollars", "around $100", "shoes over 30 and under 80", "$15 gift", "no price here", "35 - 20")


@query("SELECT * FROM (VALUES (1, NULL, 50.0), (2, 20.0, 35.0), (3, 80.0, 120.0), (4, 30.0, 80.0), (5, NULL, 15.0), (6, NULL, NULL), (7, 20.0, 35.0)) v(key, price_min, price_max)".replace("NULL, 50.0", "CAST(NULL AS DOUBLE), CAST(50 AS DOUBLE)"))
def q_price_extract(spark, d):
    rows = _rows(spark, "key int, message string", *enumerate(_SAID, 1))
    return extract.price_bounds(rows, "message").select("key", "price_min", "price_max")


@query()
def q_phrase_longest_match(spark, d):
    reg = registry.build_registry(registry.unpivot(products(spark, d), "asin", "title", "color", "category"))
    said = products(spark, d).select(F.concat(F.lit("asin:"), "asin").alias("key"), F.concat_ws(" ", F.lit("show me a"), "title", F.lit("or something"), "color").alias("message"))
    texts = table(spark, d, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("key"), F.col("text").alias("message"))
    return extract.phrase_spans(said.unionByName(texts), "key", "message", reg)


@query()
def q_size_extract(spark, d):
    return extract.sizes(_rows(spark, "key int, message string", (1, "size 10 boots, 5-6 in heel"), (2, "a 10 x 12 x 3 cm box"), (3, "extra large or XL"), (4, "12 oz mug")), "key", "message")


@query()
def q_hash_embedding(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    e = dense.embed(rows, dense.hash_encoder(32))
    return e.select("key", F.round(dense.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {PRODUCTS} SELECT asin, 'title: ' || title || ' | color: ' || color || ' | category: ' || category || CASE WHEN asin % 3 = 0 THEN '' ELSE ' | brand: ' || brand END AS card FROM products")
def q_product_card(spark, d):
    p = products(spark, d)
    brand = F.when(F.col("asin") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("brand"))
    return p.select("asin", T.product_card(F.col("title"), color=F.array("color"), category=F.array("category"), brand=brand).alias("card"))


@query()
def q_session_state_fold(spark, d):
    t = turns(spark, d)
    colors = ["red", "blue", "green"]
    payload = F.to_json(F.struct(
        F.create_map(F.lit("color"), F.array(F.element_at(F.array(*[F.lit(c) for c in colors]), (F.col("rank") % 3 + 1)))).alias("updates"),
        F.when(F.col("override"), F.array(F.lit("color"))).otherwise(F.array().cast("array<string>")).alias("override"),
        F.when(F.col("rank") <= 3, F.col("latency")).alias("price_min"), F.array((F.col("event_id") % 2000).cast("string")).alias("recommended"),
        (F.col("rank") / 5.0 - 1).alias("margin")))
    return session.fold_sessions(t.select(F.col("session").cast("string").alias("session"), "turn", payload.alias("payload")))


@query(f"WITH {PRODUCTS} SELECT asin, title, contains(lower(title), 'red')::INT + contains(lower(title), 'bolt')::INT AS terms, contains(lower(title), 'red bolt')::INT AS phrase FROM products WHERE contains(lower(title), 'red') OR contains(lower(title), 'bolt') ORDER BY phrase DESC, terms DESC, asin LIMIT 25")
def q_catalog_title_search(spark, d):
    return retrieve.title_search(products(spark, d), "red bolt", 25).select("asin", "title", "terms", "phrase")


@query(f"WITH {PRODUCTS}, {_PTOK}, f AS (SELECT key, sum(least(1.0, score / peak)) / (SELECT count(DISTINCT slot) FROM sc) AS b FROM (SELECT *, max(score) OVER (PARTITION BY slot) AS peak FROM sc) GROUP BY key) SELECT asin, round(coalesce(b, 0) + 0.15 * {_NORM}, 6) AS score FROM products LEFT JOIN f ON f.key = asin WHERE price <= 980 ORDER BY coalesce(b, 0) + 0.15 * {_NORM} DESC, asin LIMIT 10")
def q_retrieve_buying(spark, d):
    p = retrieve.eligible(products(spark, d), None, 980.0)
    slots = bm25.slot_fusion(_slot_scores(spark, d)).select(F.col("key").alias("asin"), "bm25")
    raw = slots.where("false").select("asin", F.col("bm25").alias("raw"))
    return retrieve.buying(p, slots, raw, 2.5, 10).select("asin", F.round("score", 6).alias("score"))


@query()
def q_retrieve_browsing(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    dense_arm = _cosines(spark, d, "vec_id = 3").select(F.lit(1).alias("query"), "key", F.col("cosine").alias("score"))
    slots = bm25.slot_fusion(_slot_scores(spark, d)).select("query", "key", F.col("bm25").alias("score"))
    return retrieve.browsing(products(spark, d), dense_arm, slots, e, 4.5, 10).select("key", "position", F.round("mmr", 6).alias("mmr"))


@query("SELECT doc_id, 'bad_lang' AS violation FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 100")
def q_contract_violations(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return evaluate.violations(rows, bad_lang=F.col("lang").isin("en", "de", "fr"), short=F.col("n_chars") >= 100).select("doc_id", "violation")


@query(f"WITH {TURNS}, r AS (SELECT session, (event_id % 2500) AS asin, min(turn) AS pos FROM turns GROUP BY session, event_id % 2500), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS position FROM r WHERE asin IN (SELECT p_partkey FROM part)) SELECT session, asin, CAST(position AS INTEGER) AS position FROM k WHERE position <= 10")
def q_valid_recommendations(spark, d):
    recs = turns(spark, d).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", (F.col("event_id") % 2500).alias("a")))).alias("x"))
    recs = recs.select("session", F.transform("x", lambda v: v["a"]).alias("recommendations"))
    return evaluate.valid_recommendations(recs, products(spark, d).select("asin"))


@query(r"SELECT doc_id, regexp_replace(lower(source), '[^\p{L}\p{N}]+', '_', 'g') AS snake, CAST(len(string_split(source, 'r')) AS BIGINT) AS parts FROM documents")
def q_text_canonical(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snake_case(F.col("source")).alias("snake"), F.size(F.split("source", "r")).cast("long").alias("parts"))


@query("SELECT * FROM (VALUES (1, 12.99, 12.99), (2, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), (3, 1.0, 1299.99), (4, 20.0, 20.0), (5, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE))) v(key, loose, strict)")
def q_price_parsers(spark, d):
    rows = _rows(spark, "key int, v string", (1, "12.99"), (2, "-"), (3, "1,299.99"), (4, "from $20"), (5, "-3"))
    loose = F.when(F.col("key") == 5, F.lit(None).cast("double")).otherwise(T.first_number_price(F.col("v")))
    return rows.select("key", loose.alias("loose"), T.strict_price(F.col("v")).alias("strict"))
