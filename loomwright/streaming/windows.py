"""Event-time windows over metric streams; they go beyond the operators this engine had to match, and work on batches
and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingestion import ingest


def windowed(events: DataFrame, length: str, slide: str | None = None, by: list[str] | None = None, late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "total")


def sessions(events: DataFrame, gap: str, by: str = "user_id", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


__all__ = ["ingest", "sessions", "windowed"]
