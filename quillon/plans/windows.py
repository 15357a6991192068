"""Window-like operations (W01-W12). Every window is partitioned by a key of its table, so none needs one task for all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from .registry import query, sql_query, table


def _turns():
    return Window.partitionBy("conv_id").orderBy("turn")


def _user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("w01_run_start", "SELECT conv_id, turn, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), TRUE) AS first FROM conversations")
def run_start(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.run_start(F.col("role"), _turns()).alias("first"))


@query(
    "w02_run_bounds",
    """
    SELECT event_id, coalesce(event_type <> lag(event_type) OVER w, TRUE) AS first, coalesce(event_type <> lead(event_type) OVER w, TRUE) AS last
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def run_bounds(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", S.run_start(kind, _user()).alias("first"), S.run_end(kind, _user()).alias("last"))


@query(
    "w03_islands",
    """
    WITH b AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(value) AS low, max(value) AS high FROM i GROUP BY user_id, island
    """,
)
def islands(spark, sf_dir):
    events = S.islands(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), F.expr("INTERVAL 30 MINUTES"), ["ts", "event_id"])
    return events.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


sql_query("w04_equal_count_buckets", "SELECT event_id, CAST(ntile(96) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS bucket FROM {events}")
sql_query("w05_row_number", "SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS ordinal FROM {nation}")


@query(
    "w06_open_neighbours",
    """
    SELECT o_orderkey, CAST(lag(o_orderkey) OVER w AS VARCHAR) AS previous, CAST(lead(o_orderkey) OVER w AS VARCHAR) AS next
    FROM orders WHERE o_orderstatus <> 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
)
def open_neighbours(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    open_ones = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return open_ones.select("o_orderkey", F.lag("o_orderkey").over(w).cast("string").alias("previous"), F.lead("o_orderkey").over(w).cast("string").alias("next"))


@query(
    "w07_quick_repeat",
    "SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE, FALSE) AS quick FROM events",
)
def quick_repeat(spark, sf_dir):
    step = F.col("ts") - F.lag("ts").over(_user())
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(step < F.expr("INTERVAL 10 MINUTES"), F.lit(False)).alias("quick"))


sql_query(
    "w08_running_total",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto
    FROM {lineitem}""",
)


@query(
    "w10_centred_mean",
    """
    SELECT event_id, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) / 5, 6) AS smooth
    FROM events
    """,
)
def centred_mean(spark, sf_dir):
    mean = S.centred_mean(F.col("value").cast("decimal(18,2)"), _user(), 5)
    return table(spark, sf_dir, "events").select("event_id", F.round(mean.cast("double"), 6).alias("smooth"))


@query(
    "w11_trim",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT user_id, min(i) FILTER (value > 100) - 4 AS a, max(i) FILTER (value > 100) + 12 AS z FROM r GROUP BY user_id)
    SELECT event_id FROM r JOIN b USING (user_id) WHERE i BETWEEN a AND z
    """,
)
def trim(spark, sf_dir):
    """From 4 rows before the first value above the threshold to 12 rows after the last."""
    whole = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(_user()))
    loud = F.when(F.col("value") > 100, F.col("i"))
    return rows.withColumn("a", F.min(loud).over(whole) - 4).withColumn("z", F.max(loud).over(whole) + 12).filter("i between a and z").select("event_id")


sql_query(
    "w12_successor",
    "SELECT n_nationkey, CAST(pmod(n_nationkey + 1, count(*) OVER (PARTITION BY n_regionkey)) AS BIGINT) AS successor FROM {nation}",
    "SELECT n_nationkey, (n_nationkey + 1) % count(*) OVER (PARTITION BY n_regionkey) AS successor FROM nation",
)
