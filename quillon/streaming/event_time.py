"""Streams in event time: rows told apart within a watermark, sessions, and a left outer join of two streams.

All write in append mode: a row comes out once, when the watermark has passed all that could change it, and state goes with
it. What the watermark has not passed at the end of a run stays in the checkpoint for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def different(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row to come of those that agree in keys, as long as they come within `late` of event time of it. Ids are held
    no longer than that, so state does not grow with the stream; a copy that comes later may come out again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, started, ended and n of each session: rows of a key whose steps in time are below gap. ended is the last row's time
    plus gap, from which on nothing can join the session."""
    windows = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def left_outer(events: DataFrame, kind: str, earlier: str, within: str, late: str = "1 hour") -> DataFrame:
    """kind_id, kind_ts and earlier_id: events of a kind with those of the other kind of the same user at most `within` before
    them, or null if there are none, which is known once the watermark has passed the event."""

    def side(name: str) -> DataFrame:
        rows = events.filter(F.col("event_type") == name)
        return rows.select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", late)

    near = F.expr(f"{kind}_user = {earlier}_user AND {earlier}_ts BETWEEN {kind}_ts - INTERVAL {within} AND {kind}_ts")
    return side(kind).join(side(earlier), near, "leftOuter").select(f"{kind}_id", f"{kind}_ts", f"{earlier}_id")
