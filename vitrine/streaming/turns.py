"""Structured Streaming entry points: turn events in, session states and windowed counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.session import fold_stream

TURN_SCHEMA = "session string, turn int, payload string"


def session_states(spark: SparkSession, path: str) -> DataFrame:
    """Session states from turn files (JSON lines) as they arrive in a folder."""
    return fold_stream(spark.readStream.schema(TURN_SCHEMA).json(path))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts and values in tumbling windows; later events than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
