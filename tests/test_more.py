"""Routing, sessions, groups, annotation rules, contracts and the hold ladder on rows of our own."""

import json

from pyspark.sql import functions as F

from vitrine.functions import annotations as A
from vitrine.functions import semantic as S
from vitrine.functions import text as T
from vitrine.operators import contracts, groups, ranking, routing, semantic, session
from vitrine.operators.facets import MAX_TURNS, MISS_TURN


def values(spark, schema, rows, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()]


SAID = [
    ("i need a jacket, budget of sorts, any brand", "BUYING"), ("show me the color and the fabric", "BUYING"), ("hello there, thank you", "BROWSING"), ("", "BROWSING"),
    ("not sure yet, just browsing", "BROWSING"), ("could you compare some ideas for gifts", "BROWSING"), ("i want something nice", "BROWSING"),
    ("something cheap in my size", "BUYING"), ("still deciding, show me what options you have", "BROWSING"), ("an affordable brand for now", "BUYING"),
]


def test_router_on_own_sentences(spark):
    rows = routing.classify(spark.createDataFrame(SAID, "text string, want string"), "text").collect()
    assert [r["intent"] for r in rows] == [w for _, w in SAID]
    empty = [r for r in rows if r["text"] == ""][0]
    assert (empty["confidence"], empty["margin"]) == (0.55, 0.0)
    nice = [r for r in rows if "something nice" in r["text"]][0]
    assert "request_verb" not in nice["signals"] and "vague_head" in nice["signals"]  # a request alone is no evidence
    size = [r for r in rows if "my size" in r["text"]][0]
    assert size["signals"] == ["budget", "size"] and abs(size["margin"] - (0.35 + 1.25 * 2.5)) < 1e-9


def test_router_two_phases(spark):
    rows = spark.createDataFrame([("a coat", 3), ("a coat", 5), ("a coat", 9), ("not sure, just browsing", 4), ("a coat", 1), ("show me brands", 0)], "text string, n int")
    got = [(r["intent"], round(r["confidence"], 2), r["tier"]) for r in routing.classify(rows, "text", tags=F.col("n")).collect()]
    assert got[:3] == [("BUYING", 0.8, "tags"), ("BUYING", 0.92, "tags"), ("BUYING", 0.99, "tags")]
    assert got[3][0] == "BROWSING" and got[3][2] == "rules" and got[4] == ("BROWSING", 0.7, "default") and got[5][0] == "BUYING"


def test_markers(spark):
    rows = [("actually, make it brown", "color"), ("I don't have a preference", "color"), ("you decide", None), ("blue color", "color"), ("a red one", "color"),
            ("Those options are not quite right yet. Ask me about one specific attribute.", None)]
    got = values(spark, "m string, asked string", rows, o=routing.override_marked(F.col("m")), n=routing.no_preference(F.col("m"), F.col("asked")),
                 u=routing.unsolicited(F.col("m"), F.col("asked")), g=routing.generic_reply(F.col("m")))
    assert [r[0] for r in got] == [True, False, False, False, False, False] and [r[1] for r in got] == [False, True, False, False, False, False]
    assert [r[2] for r in got] == [True, False, False, False, True, False] and [r[3] for r in got] == [False] * 5 + [True]
    fix = values(spark, "m string, a array<string>, b array<string>, c map<string,double>", [
        ("rather not", ["color", "size"], ["size", "style"], {"size": 0.95}), ("rather", ["color"], ["color"], {"color": 0.5}), ("red", ["color"], ["color"], None)],
        f=routing.correction_fields(F.col("m"), F.col("a"), F.col("b"), F.col("c")))
    assert fix == [(["size"],), ([],), ([],)]


def test_session_rules():
    s = session.new_state()
    s = session.step(s, {"turn": 1, "price_min": 10.0, "price_max": 50.0, "updates": {"color": ["red"]}, "message": "red", "summary": "wants red", "ask": "other", "margin": 1.0})
    s = session.step(s, {"turn": 2, "price_min": 20.0, "price_max": 90.0, "updates": {"size": ["m"]}, "ask": "size"})
    assert (s["price_min"], s["price_max"], s["cycle"], s["asked"]) == (20.0, 50.0, 1, {"size": 1})
    s = session.step(s, {"turn": 3, "price_max": 80.0, "updates": {"color": ["blue"]}, "override": ["color"], "message": "blue"})
    assert (s["price_min"], s["price_max"]) == (20.0, 50.0)  # only price among the replaced fields replaces bounds
    assert s["text"] == ["blue"] and s["transcript"] == ["red", "blue"] and s["summary"] == ["wants red"] and s["asked"] == {}
    s = session.step(s, {"turn": 4, "price_max": 80.0, "override": ["price"], "ask": "other"})
    assert (s["price_min"], s["price_max"]) == (None, 80.0)
    assert session.step(s, {"turn": 5})["stopped"] and not session.step(s, {"turn": 5, "updates": {"size": ["l"]}})["stopped"]
    assert session.step(s, {"turn": 6, "margin": -2.0, "explicit": True, "unsolicited": False})["mode"] == "BUYING"
    assert session.step(s, {"turn": 6, "margin": -2.0, "explicit": True})["mode"] == "BROWSING"
    assert session.step(session.new_state(), {"turn": 1, "margin": -2.0, "seed": "BUYING"})["mode"] == "BUYING"


def test_semantic_cleanup(spark):
    got = values(spark, "x string", [("I'd like something that doesn't itch, Levi’s please",), ("",), (None,), ("the of and",)], t=S.query_tokens(F.col("x")), g=S.query_ngrams(F.col("x")))
    assert got[0][0] == ["not", "itch", "levis"] and got[0][1] == ["not", "itch", "levis", "not itch", "itch levis", "not itch levis"]
    assert [r[0] for r in got[1:]] == [[], [], []]


def test_annotation_rules(spark):
    got = values(spark, "v array<string>", [(["4-way stretch", "Stretchy", "quick dry", "XL", "12 inch", "best", "Pull-On", "pull on"],), ([],)],
                 f=A.model_list("feature", F.col("v")), c=A.fact_list("color", F.col("v")))
    assert got[0][0] == ["four way stretch", "quick drying", "pull on"] and got[0][1] == ["4_way_stretch", "stretchy", "quick_dry"] and got[1] == ([], [])
    bad = values(spark, "v array<string>", [(["a", "A"],), (["a", " "],), (["a", "b", "c"],), (["a"],), (None,), (["a", None],)], p=A.list_problem(F.col("v"), 2), q=A.list_problem(F.col("v"), 2, "truncate"))
    assert [r[0] for r in bad] == ["duplicate", "blank", "too_many", None, "missing", "null_value"] and bad[2][1] is None
    reply = values(spark, "r string", [('{"a": 1, "b": 2}',), ('{"a": 1}',), ('{"a": 1, "b": 2, "c": 3}',), ("no",)], p=A.reply_problem(F.col("r"), ("a", "b")))
    assert [r[0] for r in reply] == [None, "missing_keys", "unknown_keys", "not_json"]
    text = values(spark, "x string", [("O’Neill's  'quoted'",)], n=A.natural_value(F.col("x")), d=A.display_value(F.lit("Dark_blue-ish ")))
    assert text == [("o'neill's quoted", "dark blue ish")]


def test_query_groups(spark):
    active = spark.createDataFrame([(1, "color", 0, "Navy"), (1, "color", 1, "navy "), (1, "size", 0, "M")], "query int, slot string, pos int, value string")
    ev = spark.createDataFrame([
        (1, "color", "color:navy", "Navy", 0.99), (1, "color", "color:dark_blue", "dark-blue", 0.95), (1, "color", "color:ink", "inky", 0.93), (1, "color", "color:sea", "sea", 0.92),
        (1, "color", "color:sky", "sky", 0.915), (1, "color", "color:far", "far", 0.90), (1, "style", "style:slim", "slim fit", float("nan"))],
        "query int, slot string, canonical_id string, raw_text string, confidence double")
    sem = spark.createDataFrame([(1, "color", 0, "far"), (1, "color", 1, "teal"), (1, "feature", 0, "Warm")], "query int, slot string, pos int, value string")
    rows = {r["slot"]: r for r in groups.compile_groups(active, ev, sem).collect()}
    assert rows["color"]["phrases"] == ["navy", "dark blue", "ink", "inky", "sea", "teal"]  # three that add a term; far is evidenced
    assert rows["feature"]["phrases"] == ["warm"] and "size" not in rows and "style" not in rows
    table = groups.phrase_table(groups.compile_groups(active, ev, sem))
    assert table.where("slot = 'feature'").count() == 4
    x = values(spark, "p array<string>, c array<string>", [(['a "b"', "c"], ["title", "color"])], e=groups.expression(F.col("p"), F.col("c")))
    assert x == [('{title color} : ("a ""b""" OR "c")',)]


def test_contracts(spark):
    fact = lambda a, c: (a, c, "shown")
    schema = ("sample_id string, target_asin string, scenario_type string, hidden_facts array<struct<attribute:string,canonical:string,display:string>>, initial_message string, "
              "initial_fact_id string, override_turn int, override_fact_id string, override_message string")
    good = ("s1", "p1", "buying", [fact("color", "red"), fact("size", "m")], "hi", "color:red", None, None, None)
    rows = [good, ("s2", "p9", "browsing", [fact("color", "red")], " ", "color:red", None, None, None),
            ("s3", "p1", "intent_override", [fact("color", "red"), fact("color", "blue")], "x", "color:red", 5, "color:blue", "y")]
    catalog = spark.createDataFrame([("p1",)], "parent_asin string")
    got = {(r["key"], r["violation"]) for r in contracts.session_violations(spark.createDataFrame(rows, schema), catalog).collect()}
    assert {v for k, v in got if k == "s2"} == {"facts_count", "no_message", "initial_disclosed", "unknown_target"}
    assert {v for k, v in got if k == "s3"} == {"repeated_attribute", "override_turn", "override_same", "repeated_target"}
    assert {v for k, v in got if k == "s1"} == {"repeated_target"}
    ok = {"message": "m", "ask_attribute": "color", "recommendations": [{"parent_asin": "a", "score": 1.0}]}
    bad = {"message": "m", "ask_attribute": "mood", "recommendations": [{"parent_asin": " "}], "usage": {"prompt_tokens": -1, "completion_tokens": 2}, "x": 1}
    answers = spark.createDataFrame([(1, json.dumps(ok)), (2, json.dumps(bad)), (3, "[]"), (4, json.dumps({"message": "m"}))], "key int, response string")
    found = {(r["key"], r["violation"]) for r in contracts.response_violations(answers).collect()}
    assert {v for k, v in found if k == 2} == {"ask_attribute", "empty_asin", "usage_values", "unknown_fields"} and not {v for k, v in found if k == 1}
    assert (3, "not_an_object") in found and (4, "missing_fields") in found


def test_hold_ladder(spark):
    rows = [("a", t, 5, 0.99, "color", True) for t in (1, 2, 3)] + [("b", 1, 5, 0.01, "color", True), ("b", 2, 5, 0.99, None, True), ("b", 3, 5, 0.99, "x", False), ("b", MAX_TURNS, 1, 1.0, "x", True)]
    t = spark.createDataFrame(rows, "session string, turn int, rank int, probability double, ask_attribute string, progress boolean")
    got = {(r["session"], r["turn"]): (r["recommend"], r["reason"]) for r in ranking.hold_or_recommend(t).collect()}
    value = lambda turn, rank: 0.5 + 0.3 / rank + 0.2 * (MISS_TURN - turn) / 10
    assert value(1, 5) / value(2, 1) < 0.99
    assert [got["a", k][0] for k in (1, 2, 3)] == [False, True, False] and got["a", 2][1] == "waited_before"
    assert [got["b", k][1] for k in (1, 2, 3, MAX_TURNS)] == ["below_threshold", "nothing_asked", "no_progress", "final_turn"]
    assert all(r["recommend"] for r in ranking.hold_or_recommend(t, allow_wait=False).collect())


def test_small_text_helpers(spark):
    got = values(spark, "t array<string>, a map<string,string>, b map<string,string>", [([" Slim ", "slim", "--", "Warm"], {"x": "1", "y": "2"}, {"x": "1", "y": "3", "z": "4"})],
                 tags=T.clean_tags(F.col("t")), diff=T.changed_fields(F.col("a"), F.col("b")), card=T.lines_card(F.lit("Boot"), color=F.array(F.lit("red")), size=F.array().cast("array<string>")))
    assert got == [(["slim", "warm"], {"y": "3", "z": "4"}, "color: red\ntitle: Boot")]
    assert ranking.mode_of(" Browsing ") == "BROWSING" and ranking.encoder_fits({"model": "x/Enc", "dimension": 8}, "enc", 8)


def test_registry_checks(spark):
    reg = spark.createDataFrame([("color:dark_blue", "color", "dark blue", 3), ("color:Red", "color", "red", 0)], "canonical_id string, attribute string, normalized string, count int")
    look = spark.createDataFrame([("dark blue", "color:dark_blue"), ("green", "color:green")], "normalized string, canonical_id string")
    got = {(r["problem"], r["id"]) for r in semantic.registry_problems(reg, look).collect()}
    assert got == {("wrong_id", "color:Red"), ("no_products", "color:Red"), ("not_in_lookup", "color:Red"), ("not_in_registry", "color:green")}
