"""Keyed event state as Structured Streaming: filtered events, idempotent flags, re-derived views and resets.

Each stream reads new files of a folder or glob, and ends when all that is there has been read (availableNow); the same
plans run with any other trigger. State and results live in folders that the caller names, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..operators.sequences import latest


def read_events(spark: SparkSession, glob: str, files_a_batch: int | None = None) -> DataFrame:
    """Events as a stream; the schema comes from the files there are. Zone-less times become UTC times for watermarks.

    files_a_batch bounds a micro-batch; without it, a first batch holds all files that are there.
    """
    reader = spark.readStream.schema(spark.read.parquet(glob).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(glob).withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def accepted(events: DataFrame) -> DataFrame:
    """Events of an expected kind whose outcome is good; who sent them does not matter."""
    return events.filter(F.col("event_type").isin("purchase", "signup", "view") & (F.col("value") > 100))


def _drain(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def append_all(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Rows of a stateless stream, in files written exactly once."""
    _drain(stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return stream.sparkSession.read.parquet(folder)


def flags(events: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """(user_id, event_type, solved, first_ts): a flag that is set once and stays; repeated events change nothing.

    Every micro-batch writes the keys it changed under its own number, so that a repeated batch replaces itself.
    """
    state = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch_no={number}")

    _drain(state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    found = state.sparkSession.read.parquet(folder)
    return latest(found, ["user_id", "event_type"], ["batch"], ["first_ts"]).withColumn("solved", F.lit(True))


def stages(solved: DataFrame, required: list[str]) -> DataFrame:
    """The view derived from the flags: by user, how many are set and whether all required ones are."""
    return solved.groupBy("user_id").agg(F.count("*").alias("n_solved"), (F.count_if(F.col("event_type").isin(required)) == len(required)).alias("open"))


def with_resets(events: DataFrame, folder: str, checkpoint: str, reset_kind: str = "error") -> DataFrame:
    """(user_id, n_solved): kinds of event seen since the user's last reset.

    The state of a user is its set of kinds. Within a batch, events count in the order of time and number.
    """
    spark = events.sparkSession
    ship(spark)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # Batches of a group are parts in any order, so the last reset and the last time of each kind are kept, not the rows.
        kinds = set(state.get[0].split(",")) if state.exists and state.get[0] else set()
        order = ["ts", "event_id"]
        parts = [rows.sort_values(order).drop_duplicates("event_type", keep="last") for rows in batches]
        found = pd.concat(parts).sort_values(order).drop_duplicates("event_type", keep="last")
        last = dict(zip(found["event_type"], zip(found["ts"], found["event_id"])))
        reset = last.pop(reset_kind, None)
        kinds = {k for k, at in last.items() if reset is None or at > reset} | (kinds if reset is None else set())
        state.update((",".join(sorted(kinds)),))
        yield pd.DataFrame({"user_id": [key[0]], "n_solved": [len(kinds)]})

    stream = events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n_solved bigint", "kinds string", "update", "NoTimeout")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch_no={number}")

    _drain(stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return latest(spark.read.parquet(folder), ["user_id"], ["batch"], ["n_solved"])


def since_reset(events: DataFrame, folder: str, checkpoint: str, reset_kind: str = "error") -> DataFrame:
    """(user_id, n_solved): kinds of event since the user's last reset, by time and number, in whatever order they come.

    The state is the last place of each kind of a user, a reset's among them, so it stays on the JVM and has a row for each.
    A kind whose last event is before the reset does not count. Null users are no users, and a null kind is none.
    """
    rows = events.filter("user_id is not null").select("user_id", "event_type", F.struct("ts", "event_id").alias("place"))
    state = rows.groupBy("user_id", "event_type").agg(F.max("place").alias("last"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch_no={number}")

    _drain(state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    found = latest(state.sparkSession.read.parquet(folder), ["user_id", "event_type"], ["batch"], ["last"])
    reset = F.max(F.when(F.col("event_type") == reset_kind, F.col("last"))).over(Window.partitionBy("user_id"))
    counts = (F.col("event_type") != reset_kind) & (F.col("reset").isNull() | (F.col("last") > F.col("reset")))
    return found.withColumn("reset", reset).groupBy("user_id").agg(F.count_if(counts).alias("n_solved"))


def windowed_counts(events: DataFrame, folder: str, checkpoint: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by kind and time window, with a watermark that lets state of old windows go."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch_no={number}")

    _drain(counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return latest(counts.sparkSession.read.parquet(folder), ["start", "event_type"], ["batch"], ["n"])


def interval_join(events: DataFrame, kind: str, earlier: str, within: str, late: str = "1 hour") -> DataFrame:
    """Ids of events of a kind and of those of the other kind at most `within` before them, by user. Watermarks and the bound
    tell how long a row of either side can still meet another, so state does not grow with the stream."""
    side = lambda name, value: events.filter(F.col("event_type") == value).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", late)
    near = F.expr(f"{kind}_user = {earlier}_user AND {earlier}_ts BETWEEN {kind}_ts - INTERVAL {within} AND {kind}_ts")
    return side(kind, kind).join(side(earlier, earlier), near)
