"""Session state: an ordered fold of turns with tightening, overrides that prune dependants, exclusions, hysteresis."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which fields hang on which.
CHILDREN = {"category": ("use_case", "size", "style"), "use_case": ("feature", "material", "style")}
#: What hangs on a field, directly or not; the fields that a field hangs on, the nearest first.
BELOW = {"category": frozenset({"use_case", "size", "style", "feature", "material"}), "use_case": frozenset(CHILDREN["use_case"])}
PARENTS = {f: tuple(p for p in ("use_case", "category") if f in BELOW[p]) for f in sorted(BELOW["category"])}
FLIP = 0.80
#: Fields that a clarifying question may ask for.
ASKABLE = frozenset({"budget", "brand", "size", "color", "material", "feature", "style", "use_case", "category"})


def descendants(field: str) -> frozenset[str]:
    return BELOW.get(field, frozenset())


def goal_segments(turns: DataFrame) -> DataFrame:
    """Adds `segment`: overrides so far, this turn included."""
    order = Window.partitionBy("session").orderBy("turn")
    return turns.withColumn("segment", F.sum(F.col("override").cast("int")).over(order))


def segment_bounds(turns: DataFrame) -> DataFrame:
    """(session, segment, price_min, price_max, turns): bounds tighten within a segment."""
    return goal_segments(turns).groupBy("session", "segment").agg(
        F.max("price_min").alias("price_min"), F.min("price_max").alias("price_max"), F.count("*").alias("turns"))


def new_state() -> dict[str, Any]:
    return {"turn": 0, "values": [], "price_min": None, "price_max": None, "excluded": [], "last": [], "mode": None, "asked": {}, "cycle": 0, "stopped": False, "last_asked": None,
            "text": [], "transcript": [], "summary": []}


def step(state: dict[str, Any], turn: dict[str, Any]) -> dict[str, Any]:
    """One turn: `updates` (attribute -> values), `inferred` (attributes whose values hang on others), `override` (fields to
    replace), `price_min`, `price_max`, `recommended`, `margin`, `explicit` (explore signal), `message`. Late and repeated turns are dropped."""
    if turn["turn"] <= state["turn"]:
        return state
    s = {**state, "turn": turn["turn"]}
    updates: dict[str, list[str]] = turn.get("updates") or {}
    lo, hi = turn.get("price_min"), turn.get("price_max")
    override = [f for f in turn.get("override") or [] if updates.get(f) or (f == "price" and (lo is not None or hi is not None))]
    if override:
        gone = frozenset().union(*map(descendants, override))
        roots = [f for f in override if f not in gone]
        values = [v for v in s["values"] if v["attribute"] not in roots]
        values = [v for v in values if v["source"] == "explicit" or v["attribute"] not in gone]
        have = {(v["attribute"], v["value"]) for v in values}
        while True:  # what hangs on a value that is gone goes too
            rest = [v for v in values if v["source"] == "explicit" or v["parent"] is None or tuple(v["parent"]) in have]
            if len(rest) == len(values):
                break
            values, have = rest, {(v["attribute"], v["value"]) for v in rest}
        s.update(values=values, excluded=[], last=[], asked={}, last_asked=None, stopped=False, text=[])
    else:
        s["excluded"] = list(dict.fromkeys([*s["excluded"], *s["last"]]))
    values = list(s["values"])
    for attribute, new in updates.items():
        inferred = attribute in (turn.get("inferred") or [])
        for value in new:
            if any(v["attribute"] == attribute and v["value"] == value for v in values):
                continue
            parent = next(([v["attribute"], v["value"]] for p in PARENTS.get(attribute, ()) for v in values if v["attribute"] == p), None)
            values.append({"attribute": attribute, "value": value, "source": "inferred" if inferred else "explicit", "parent": parent if inferred else None})
    s["values"] = values
    if "price" in override:  # replaced as a whole, an open end included
        s["price_min"], s["price_max"] = lo, hi
    else:
        s["price_min"] = max((x for x in (s["price_min"], lo) if x is not None), default=None)
        s["price_max"] = min((x for x in (s["price_max"], hi) if x is not None), default=None)
    s["last"] = list(turn.get("recommended") or [])
    # Three streams: what retrieval reads starts anew with an override, transcript and summaries never do.
    for stream, text in (("text", turn.get("message")), ("transcript", turn.get("message")), ("summary", turn.get("summary"))):
        if text and text.strip():
            s[stream] = [*s[stream], text.strip()]
    # An answer to "other" starts a new cycle of questions; an empty one ends them.
    if s["last_asked"] == "other" and not override:
        if updates or lo is not None or hi is not None:
            s.update(cycle=s["cycle"] + 1, asked={}, stopped=False)
        else:
            s["stopped"] = True
    asked = turn.get("ask")
    s["last_asked"] = asked
    if asked in ASKABLE:
        s["asked"] = {**s["asked"], asked: s["asked"].get(asked, 0) + 1}
    margin = turn.get("margin")
    if margin is not None:
        want = "BUYING" if margin >= 0 else "BROWSING"
        if s["mode"] is None:
            s["mode"] = turn.get("seed") or want
        elif turn.get("unsolicited", True) and want != s["mode"] and abs(margin) >= FLIP and (want == "BUYING" or turn.get("explicit")):
            s["mode"] = want
    return s


STATE_SCHEMA = "session string, turn int, mode string, price_min double, price_max double, n_values int, n_excluded int, state string"


def _row(session: str, s: dict[str, Any]) -> tuple:
    return (session, s["turn"], s["mode"], s["price_min"], s["price_max"], len(s["values"]), len(s["excluded"]), json.dumps(s, sort_keys=True))


def fold_sessions(turns: DataFrame) -> DataFrame:
    """(session string, turn int, payload: JSON of a turn) -> the state after each session's last turn. A session is at most a few turns."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        s = new_state()
        for turn, payload in sorted(zip(p["turn"], p["payload"])):
            s = step(s, {**json.loads(payload), "turn": int(turn)})
        return pd.DataFrame([_row(p["session"].iloc[0], s)], columns=[x.split()[0] for x in STATE_SCHEMA.split(", ")])

    return turns.groupBy("session").applyInPandas(run, STATE_SCHEMA)


def fold_stream(turns: DataFrame) -> DataFrame:
    """The same over a stream, with the state kept between micro-batches; emits each session's state when it changes."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        s = json.loads(held.get[0]) if held.exists else new_state()
        rows = pd.concat(list(batches))
        for turn, payload in sorted(zip(rows["turn"], rows["payload"])):
            s = step(s, {**json.loads(payload), "turn": int(turn)})
        held.update((json.dumps(s, sort_keys=True),))
        yield pd.DataFrame([_row(key[0], s)], columns=[x.split()[0] for x in STATE_SCHEMA.split(", ")])

    return turns.groupBy("session").applyInPandasWithState(run, STATE_SCHEMA, "state string", "update", GroupStateTimeout.NoTimeout)
