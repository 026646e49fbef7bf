"""Secret scans with a trigram inverted index, by DataFrame operations only.

Every rule's regex is analysed into a Boolean trigram query: an OR of ANDs of trigrams that each match must contain,
whatever its letter case. The index has a posting (trigram, doc_id) for the trigrams that some query names; a rule's
postings are intersected, and only documents that satisfy its query are verified by the regex itself. A rule without
mandatory trigrams, such as a run of hex digits, scans every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only, prepare

#: Strings that the analysis follows side by side before it gives up exactness.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind; regex (Java and RE2 syntax); the group that `least` counts the characters of."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The base kinds of the contract, in their order.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Kinds that the method adds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that holds for every match; [frozenset()] if nothing is mandatory."""
    exact, query = _analyse(parser.parse(regex))
    query = _and(query, _of(exact))
    return sorted({q for q in query if not any(p < q for p in query)}, key=sorted)


_ALL = [frozenset()]


def _of(strings: set[str]) -> list[frozenset[str]]:
    if not strings or any(len(s) < 3 for s in strings):
        return _ALL
    return list({_trigrams(s) for s in strings})


def _and(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    out = {x | y for x in a for y in b}
    return list(out) if len(out) <= MAX_STRINGS else (a if a != _ALL else b)


def _analyse(tree) -> tuple[set[str], list[frozenset[str]]]:
    """(strings, query): a match is one of the strings after a part that satisfies the query.

    The strings are the possible tails since the last inexact part; {""} after such a part."""
    strings, query = {""}, _ALL
    for op, arg in tree:
        part = _strings(op, arg)
        if part is not None and len(part) * len(strings) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in part}
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:  # at least one of it comes right after the strings
            once = _exact(arg[2])
            if once is not None and len(once) * len(strings) <= MAX_STRINGS:
                strings = {a + b for a in strings for b in once}
        query = _and(query, _of(strings))
        strings = {""}
        if part is not None:
            strings = part
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            inner, q = _analyse(arg[2])
            query = _and(query, _and(q, _of(inner)))
        elif op is sre.SUBPATTERN:
            inner, q = _analyse(arg[3])
            query = _and(query, _and(q, _of(inner)))
        elif op is sre.BRANCH:
            options = [_and(q, _of(s)) for s, q in map(_analyse, arg[1])]
            either = [x for o in options for x in o]
            query = _and(query, _ALL if frozenset() in either else either)
    return strings, query


def _strings(op, arg) -> set[str] | None:
    """The strings that a node can match if they are few, else None."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 4:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact(arg[3])
    if op is sre.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 8:
        inner, out = _exact(arg[2]), set()
        if inner is None or len(inner) ** int(arg[1]) > MAX_STRINGS:
            return None
        power = {""}
        for n in range(int(arg[1]) + 1):
            if n >= arg[0]:
                out |= power
            power = {a + b for a in power for b in inner}
        return out
    if op is sre.AT:
        return {""}
    return None


def _exact(tree) -> set[str] | None:
    out = {""}
    for op, arg in tree:
        part = _strings(op, arg)
        if part is None or len(part) * len(out) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the inverted index of the named trigrams over lower-cased texts."""
    text = F.lower(F.col("text"))
    found = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return docs.select("doc_id", text.alias("low")).select(F.explode(found).alias("trigram"), "doc_id").distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document satisfies, from the intersected postings."""
    spark = docs.sparkSession
    terms = [
        (r.kind, f"{r.kind}{i}", t, len(q))
        for r in rules for i, q in enumerate(trigram_query(r.regex)) for t in sorted(q)
    ]
    index = cut(postings(docs, sorted({t for _, _, t, _ in terms})))
    wanted = spark.createDataFrame(terms, "kind string, conjunction string, trigram string, need int")
    hits = index.join(F.broadcast(wanted), "trigram")  # as many rows as the rules' queries name trigrams
    met = hits.groupBy("doc_id", "kind", "conjunction", "need").agg(F.count("*").alias("n")).where("n = need")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array of struct(start, kind order, end, kind) of a rule's matches, leftmost and non-overlapping, short ones dropped.

    The text between the matches and the matches themselves alternate, so running lengths give the offsets."""
    pattern = F.lit(rule.regex)
    rows = F.arrays_zip(
        F.transform(F.split(text, rule.regex, -1), lambda p: F.length(p)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda p: F.length(p)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda p: F.length(p)).alias("part"),
    )
    zero = F.struct(
        F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(
            end.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _test(rule: Rule) -> str:
    """A regex that every kept match of a rule without trigrams satisfies; spares the offsets' work elsewhere."""
    plain = rule.group == 0 and re_plus(rule.regex)
    return f"{rule.regex[:-1]}{{{rule.least},}}" if plain and rule.least else rule.regex


def re_plus(regex: str) -> bool:
    """Whether the regex is one class repeated."""
    tree = parser.parse(regex)
    return len(tree) == 1 and regex.endswith("]+")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, base: int = len(BASE)) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, n_<kind> of the base rules, base_sha256, spans: one row for each row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans (base_sha256 is that of the empty text).
    Rows that repeat a doc_id are verified each by itself; rows with a null doc_id take part as one posting. An empty
    table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    indexed = tuple(r for r in rules if all(trigram_query(r.regex)))
    found = candidates(rows, indexed).select(F.col("doc_id").alias("d"), "kinds")
    each = rows.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")), "left")
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    for i, r in enumerate(rules):
        due = F.array_contains("kinds", r.kind) if r in indexed else F.col("text").rlike(_test(r))
        each = each.withColumn(f"s{i}", F.when(due, _spans(F.col("text"), r, i)).otherwise(none))
    of = lambda n: F.sort_array(reduce(lambda a, b: F.concat(a, b), [F.col(f"s{i}") for i in range(n)]))
    return each.select(
        "doc_id",
        *[F.size(f"s{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])],
        F.sha2(_joined(of(base)).cast("binary"), 256).alias("base_sha256"),
        _joined(of(len(rules))).alias("spans"),
    )


def _oracle() -> str:
    """The same by plain regex scans."""
    parts = []
    for i, r in enumerate(BASE + ADDED):
        regex = r.regex.replace("'", "''")
        parts.append(f"""
  SELECT k, '{r.kind}' AS kind, {i} AS ord, unnest(range(1, len(m) + 1)) AS i, g, m, p FROM (
    SELECT k, string_split_regex(text, '{regex}') AS g, regexp_extract_all(text, '{regex}', 0) AS m,
           regexp_extract_all(text, '{regex}', {r.group}) AS p FROM d) WHERE len(m) > 0""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT k, kind, ord, length(p[i]) AS part,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
    length(m[i]) AS n FROM raw),
kept AS (SELECT k, kind, ord, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM placed
  WHERE part >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in BASE + ADDED)} END),
a AS (SELECT k, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS b,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM kept GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (k)
"""


ORACLE_SQL = _oracle()
