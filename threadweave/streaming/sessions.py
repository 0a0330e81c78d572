"""Sessions of posts as a stream: per conversation, closed after a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(posts: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "convo_id", time: str = "created_at") -> DataFrame:
    """``(key, start, end, n)`` per session; works on a table and on a stream, where posts later than ``late`` are dropped."""
    stream = posts.withWatermark(time, late) if posts.isStreaming else posts
    made = stream.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", key: str = "event_type", time: str = "ts") -> DataFrame:
    """``(key, start, n)`` per tumbling or sliding window, on a table or a stream."""
    stream = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")
