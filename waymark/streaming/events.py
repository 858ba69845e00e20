"""Request counters as streams: tumbling counts, sessions and a stream-static lookup,
each with the same plan for a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late="10 minutes") -> DataFrame:
    """events with ts as a timestamp (in the session's zone) and, on a stream, a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width="1 hour", late="10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) for each width of time."""
    rows = timed(events, late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap="30 minutes", late="10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): a user's events less than a gap apart."""
    rows = timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def with_plans(requests: DataFrame, plans: DataFrame, key="signature") -> DataFrame:
    """A stream of requests with the plan of the same key."""
    return requests.join(plans, key, "left")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode="append") -> None:
    """Runs a stream over all that is there now, a batch at a time, and stops."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
