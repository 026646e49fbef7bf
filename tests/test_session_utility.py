"""Session utility against its SQL: every pair of hits that ten turns and ten ranks allow, and null keys."""

from datetime import datetime, timedelta

import duckdb

from vitrine.plans.queries import ORACLES, QUERIES


def _same(spark, tmp_path, rows):
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(path)
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{path}/*.parquet')")
    found = c.sql(ORACLES["q_session_utility"])
    got = QUERIES["q_session_utility"](spark, str(tmp_path)).first().asDict()
    assert [tuple(got[x] for x in found.columns)] == found.fetchall()
    return got


def test_every_pair_of_hits(spark, tmp_path):
    """Many pairs are worth the same, up to the last bit; which of them count as better is SQL's to say."""
    start, rows, user, n = datetime(2024, 1, 1), [], 0, 0
    for first in range(1, 11):
        for then in range(first + 1, 11):
            for rank in range(10):
                for other in range(10):
                    for turn in range(1, then + 1):
                        n += 10
                        last = rank if turn == first else other
                        rows.append((n + last, user, start + timedelta(minutes=turn), "purchase" if turn in (first, then) else "view", 1.0))
                    user += 1
    assert _same(spark, tmp_path, rows)["improved"] > 0


def test_null_keys(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [
        (None, 1, at, "purchase", 1.0), (13, 1, at, "purchase", 1.0), (19, 1, at, "view", 1.0),  # no id: no rank, and last of its time
        (21, 2, None, "purchase", 1.0), (29, 2, at, "purchase", 1.0),  # no time: the last turn
        (31, None, at, "purchase", 1.0), (40, None, at, None, None), (50, 3, at, "view", 1.0),
        (None, 4, at, "purchase", 1.0), (61, 4, at + timedelta(minutes=1), "purchase", 1.0),
    ]
    _same(spark, tmp_path, rows)
