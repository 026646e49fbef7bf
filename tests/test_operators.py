"""Sources, text functions, extraction and session state on rows of our own."""

import json

import pytest
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.operators import evaluate, extract, facets, registry, session
from vitrine.sources import catalog
from vitrine.streaming.turns import session_states


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    assert one(spark, T.normalize_text(F.lit("Levi's  RED-ish, Été!"))) == "levis red ish été"
    assert spark.createDataFrame([("Ｓtraße",)], "v string").select(T.fold_unicode("v").alias("x")).first()["x"] == "strasse"
    assert one(spark, T.canonical_id(F.lit("color"), F.lit("Dark Red"))) == "color:dark_red"
    assert one(spark, T.canonical_value(F.lit("color:dark_red"))) == "dark red"


def test_ngrams_and_terms(spark):
    assert one(spark, T.all_ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("a")))) == ["a", "b", "a b", "b a", "a b a"]
    assert [(x["phrase"], x["weight"]) for x in one(spark, T.weighted_ngrams(F.lit("b a b")))] == [("b", 1.0), ("a", 1.0), ("b a", 2.0)]
    assert one(spark, T.category_path(F.lit("A > B b > C > D > E"))) == ["b_b", "c", "d", "e"]


def test_prices_and_ratings(spark):
    rows = spark.createDataFrame([("1,299.99",), ("-",), ("from $20",), (None,), ("",), ("nan",), ("-5",)], "v string")
    got = [tuple(r) for r in rows.select(T.first_number_price(F.col("v")), T.strict_price(F.col("v")), T.normalized_rating(F.col("v"))).collect()]
    assert [x[0] for x in got] == [1.0, None, 20.0, None, None, None, None]
    assert [x[1] for x in got] == [1299.99, None, 20.0, None, None, None, None]
    assert all(x[2] == 0.5 for x in got)


def test_sources(spark, tmp_path):
    p = str(tmp_path / "a.json")
    with open(p, "w") as f:
        f.write('{"parent_asin":"A","title":"x"}\nnot json\n{"parent_asin":"B","title":"y"}\n')
    assert [r[0] for r in catalog.tolerant_jsonl(spark, p, catalog.CATALOG).orderBy("parent_asin").select("parent_asin").collect()] == ["A", "B"]
    assert catalog.tolerant_jsonl(spark, str(tmp_path / "none.json"), catalog.CATALOG).count() == 0
    with pytest.raises(Exception):
        catalog.strict_jsonl(spark, p, catalog.CATALOG).collect()
    with pytest.raises(Exception):
        catalog.unique_key(spark.createDataFrame([("A",), ("A",)], "k string"), "k").collect()
    assert catalog.first_existing(spark, str(tmp_path / "none"), p) == p
    assert catalog.manifest(spark, p).first()["sha256"]
    out = str(tmp_path / "log")
    rows = spark.createDataFrame([("A", "ok")], "parent_asin string, result string")
    for _ in range(2):
        catalog.append_new(rows, out, "parent_asin string, result string")
    assert spark.read.json(out).count() == 1


def test_annotation_runner(spark):
    todo = spark.createDataFrame([("A", "p"), ("B", "bad"), ("C", "p")], "parent_asin string, prompt string")
    done = spark.createDataFrame([("C",)], "parent_asin string")

    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r["parent_asin"]: (r["result"], r["error"], r["attempt"]) for r in catalog.annotate(todo, done, call).collect()}
    assert got == {"A": ("P", None, 1), "B": (None, "no", 3)}


def test_vectors_check(spark):
    rows = spark.createDataFrame([([1.0, 0.0], True), ([0.5, 0.0], True), ([0.0, 0.0], False), ([1.0], True)], "embedding array<double>, present boolean")
    assert tuple(catalog.aligned_vectors(rows, 2).first()) == (4, 1, 0, 1, 0)


def test_metrics_fixture(spark):
    turns = spark.createDataFrame([("a", 1, False, 9), ("a", 2, True, 1), ("b", 1, False, 4)], "session string, turn int, hit boolean, rank int")
    m = evaluate.metrics(evaluate.session_results(turns)).first()
    assert (m["mttc"], m["efficiency"], m["technical"]) == (6.5, 0.45, 0.49)


def test_utility_grid(spark):
    for t, r, v in ((1, 1, 1.0), (1, 10, 0.73), (10, 1, 0.82), (10, 10, 0.55)):
        assert one(spark, facets.utility(F.lit(t), F.lit(r))) == pytest.approx(v)
    assert one(spark, facets.utility(F.lit(3), F.lit(None).cast("int"))) == 0


def test_longest_phrase(spark):
    dictionary = spark.createDataFrame([("color", "red"), ("category", "red rain boots"), ("category", "boots"), ("style", "rain")], "attribute string, normalized string")
    said = spark.createDataFrame([(1, "Red rain boots, red!")], "k int, m string")
    got = {(r["start"], r["phrase"]) for r in extract.phrase_spans(said, "k", "m", dictionary).collect()}
    assert got == {(0, "red rain boots"), (3, "red")}


def test_phrase_query_takes_every_text(spark, tmp_path):
    """The registered query over all products and documents against a brute-force matcher."""
    from vitrine.plans.queries import QUERIES

    names = ["red bolt", "blue rain boot", "rain boot", "old red"]
    parts = [(k, names[k % 4], "B", "T", 1.0) for k in range(1, 61)]
    texts = ["A Red bolt, red; blue rain boot rain boot", "old red bolt old", "", "nothing here", "rain rain boot " * 30]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 5.0)], "l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    phrases = {(n, "title") for n in names} | {(n.split()[0], "color") for n in names} | {(n.split()[1], "category") for n in names}
    said = {f"asin:{k}": f"show me a {n} or something {n.split()[0]}" for k, n, *_ in parts} | {f"doc:{k}": t for k, t in enumerate(texts)}
    want = set()
    for key, text in said.items():
        t, used = "".join(c if c.isalnum() else " " for c in text.lower()).split(), set()
        for n in (3, 2, 1):
            for i in range(len(t) - n + 1):
                found = [(p, a) for p, a in phrases if p == " ".join(t[i : i + n])]
                if found and not used & set(range(i, i + n)):
                    used |= set(range(i, i + n))
                    want |= {(key, i, n, p, a) for p, a in found}
    got = [tuple(r) for r in QUERIES["q_phrase_longest_match"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_dominance(spark):
    rows = spark.createDataFrame([("x", "a", 9), ("x", "b", 2), ("y", "a", 3), ("y", "b", 2)], "g string, value string, n long")
    assert [r["g"] for r in registry.dominant(rows, "g").collect()] == ["x"]


TURNS = [
    {"updates": {"category": ["shirt"]}, "recommended": ["p1"], "price_max": 50, "margin": 0.2},
    {"updates": {"color": ["black"]}, "recommended": ["p2"], "price_max": 40, "margin": -0.3},
    {"updates": {"use_case": ["sunny"]}, "inferred": ["use_case"], "recommended": ["p3"]},
    {"updates": {"feature": ["uv protection"]}, "inferred": ["feature"]},
    {"updates": {"category": ["hat"]}, "override": ["category"], "margin": -1.5},
]


def test_override_prunes_dependants():
    s = session.new_state()
    for k, t in enumerate(TURNS[:4], 1):
        s = session.step(s, {**t, "turn": k})
    assert s["excluded"] == ["p1", "p2", "p3"] and s["price_max"] == 40 and s["mode"] == "BUYING"
    s = session.step(s, {**TURNS[4], "turn": 5})
    assert [(v["attribute"], v["value"]) for v in s["values"]] == [("color", "black"), ("category", "hat")]
    assert s["excluded"] == [] and s["mode"] == "BUYING"  # a flip to browsing needs an explicit signal
    assert session.step(s, {**TURNS[0], "turn": 5}) == s


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(f"s{i}", k, json.dumps(t)) for i in range(3) for k, t in enumerate(TURNS, 1)]
    for part in (0, 1):  # two files: two micro-batches
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        with open(folder / f"{part}.json", "w") as f:
            for s, k, p in rows:
                if (k > 2) == bool(part):
                    f.write(json.dumps({"session": s, "turn": k, "payload": p}) + "\n")
    batch = {r["session"]: r["state"] for r in session.fold_sessions(spark.createDataFrame(rows, "session string, turn int, payload string")).collect()}
    q = session_states(spark, str(tmp_path / "in")).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("states").orderBy("turn").collect():
        last[r["session"]] = r["state"]
    assert last == batch
