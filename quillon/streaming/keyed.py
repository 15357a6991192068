"""Progress of users as keyed state with values, maps, lists and timers.

One processor holds for each user: the last reset (a value), the last event of each kind (a map), and the views that are
recent (a list), which timers in event time take off again. State lies in RocksDB, so it may be larger than memory, and a
run goes on from its checkpoint.

What counts is the order of events by time and number, not of their arrival: events from before a reset do not count even if
they come after it. So the snapshot equals the batch query over all events that the watermark let in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship
from ..operators.sequences import latest
from .solved import _drain

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id bigint, n_solved bigint, kinds array<string>, n_recent bigint, seen boolean, step int"


class Progress(StatefulProcessor):
    """reset_kind: events that delete all of a user's state. seen_kind: events that mark the user as one who has seen
    something, and are recent for recent_ms in event time."""

    def __init__(self, reset_kind: str, seen_kind: str, recent_ms: int):
        self.reset_kind, self.seen_kind, self.recent_ms = reset_kind, seen_kind, recent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reset = handle.getValueState("reset", "us bigint, event_id bigint")
        self.flags = handle.getMapState("flags", "kind string", "us bigint, event_id bigint")
        self.recent = handle.getListState("recent", "us bigint, event_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lasts, views = [], []
        for part in rows:  # parts of a batch come in any order; the last event of each kind and the views are what is needed
            part = part[["event_type", "us", "event_id"]].sort_values(["us", "event_id"])
            lasts.append(part.drop_duplicates("event_type", keep="last"))
            views.append(part[part.event_type == self.seen_kind])
        last = pd.concat(lasts).sort_values(["us", "event_id"]).drop_duplicates("event_type", keep="last")
        at = dict(zip(last.event_type, zip(last.us.tolist(), last.event_id.tolist())))
        reset = tuple(self.reset.get()) if self.reset.exists() else None
        if self.reset_kind in at and (reset is None or at[self.reset_kind] > reset):
            reset = at[self.reset_kind]
            self.reset.update(reset)
            self._forget(reset)
        for kind, place in at.items():
            if kind != self.reset_kind and (reset is None or place > reset) and not (self.flags.containsKey((kind,)) and tuple(self.flags.getValue((kind,))) >= place):
                self.flags.updateValue((kind,), place)
        views = pd.concat(views)
        views = views[views.us // 1000 + self.recent_ms > timerValues.getCurrentWatermarkInMs()]
        if reset is not None:
            views = views[(views.us > reset[0]) | ((views.us == reset[0]) & (views.event_id > reset[1]))]
        if len(views):
            self.recent.appendList(list(zip(views.us.tolist(), views.event_id.tolist())))
            self.handle.registerTimer(int(views.us.min()) // 1000 + self.recent_ms)
        yield self._snapshot(key, 0)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(row) for row in self.recent.get()]
        kept = [row for row in held if row[0] // 1000 + self.recent_ms > timerValues.getCurrentWatermarkInMs()]
        if len(kept) < len(held):
            self._keep(kept)
            yield self._snapshot(key, 1)
        if kept:
            self.handle.registerTimer(min(kept)[0] // 1000 + self.recent_ms)

    def _forget(self, reset: tuple[int, int]) -> None:
        """Deletes what is from before the reset; a later event may have come before it."""
        for (kind,) in [kind for kind, at in self.flags.iterator() if tuple(at) < reset]:
            self.flags.removeKey((kind,))
        self._keep([row for row in map(tuple, self.recent.get()) if row > reset])

    def _keep(self, recent: list[tuple[int, int]]) -> None:
        if recent:
            self.recent.put(recent)
        else:
            self.recent.clear()

    def _snapshot(self, key: tuple, step: int) -> pd.DataFrame:
        kinds = sorted(kind for (kind,) in self.flags.keys())
        n = sum(1 for _ in self.recent.get())
        return pd.DataFrame({"user_id": [key[0]], "n_solved": [len(kinds)], "kinds": [kinds], "n_recent": [n], "seen": [n > 0], "step": [step]})

    def close(self) -> None:
        pass


def progress(events: DataFrame, folder: str, checkpoint: str, reset_kind: str = "error", seen_kind: str = "view", recent_hours: int = 72, late: str = "1 hour") -> DataFrame:
    """(user_id, n_solved, kinds, n_recent, seen) of every user, from a stream of events (event_id, ts, user_id, event_type).

    kinds: kinds of event since the user's last reset, ascending; n_solved: how many. n_recent: events of seen_kind since the
    reset that the watermark has not passed by recent_hours; seen: whether there are any. Rows that are later than the
    watermark are left out, and null users or kinds are not events. Nothing else expires.
    """
    spark = events.sparkSession
    ship(spark)
    rows = events.filter("user_id is not null and event_type is not null").select("user_id", "event_type", "event_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    stream = rows.groupBy("user_id").transformWithStateInPandas(Progress(reset_kind, seen_kind, recent_hours * 3_600_000), OUTPUT, "Update", "EventTime")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch_no={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, PROVIDER)  # a query takes its provider when it starts
    try:
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        _drain(query)
    finally:
        spark.conf.set(provider, before)
    found = spark.read.schema(f"{OUTPUT}, batch int").parquet(folder)
    return latest(found, ["user_id"], ["batch", "step"], ["n_solved", "kinds", "n_recent", "seen"])
