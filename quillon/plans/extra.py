"""Relational operations beyond the reference, and global forms of W04, W05, W12 and A08."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, pandas_udf

from ..functions.shipping import ship
from ..operators import dominance
from ..operators import ranges as R
from ..sources import files
from .registry import query, sql_query, table

sql_query(
    "d_full_outer",
    "SELECT CAST(c.c_custkey AS STRING) AS c_custkey, CAST(e.user_id AS STRING) AS user_id, CAST(e.n AS STRING) AS n FROM {customer} c FULL OUTER JOIN (SELECT user_id + 20 AS user_id, count(*) AS n FROM {events} GROUP BY user_id) e ON c.c_custkey = e.user_id",
)


# One join in three ways; nation is a fixed list, so it may be broadcast by name.
_BY_NATION = "SELECT /*+ {hint} */ n_name, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey GROUP BY n_name"
for _name, _hint in (("d_merge_join", "MERGE(c, n)"), ("d_shuffled_hash_join", "SHUFFLE_HASH(n)"), ("d_broadcast_join", "BROADCAST(n)")):
    sql_query(_name, _BY_NATION.format(hint=_hint))


@query(
    "d_range_join",
    "SELECT s_suppkey, count(*) AS n, min(p_partkey) AS least FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 50 AND s_acctbal + 50 GROUP BY s_suppkey",
)
def range_join(spark, sf_dir):
    """Parts whose price lies within 50 of a supplier's balance."""
    near = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 50).alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    found = dominance.inequality_aggregate(table(spark, sf_dir, "part"), near, ("p_retailprice", ">=", "low"), ("p_retailprice", "<=", "high"), {"least": (F.min, "p_partkey")})
    return found.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


@query(
    "d_as_of_join",
    """
    SELECT p.event_id, CAST(arg_max(v.event_id, (v.ts, v.event_id)) AS VARCHAR) AS view_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts
    GROUP BY p.event_id
    """,
)
def as_of_join(spark, sf_dir):
    """The last view of the user before each purchase."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kind = lambda k: events.filter(F.col("event_type") == k).drop("event_type").withColumn("seen", F.col("event_id"))
    return R.as_of_join(kind("purchase").drop("seen"), kind("view"), "user_id", "ts", "event_id", "seen", "view_id", F.to_date).select("event_id", F.col("view_id").cast("string"))


sql_query(
    "d_cube",
    "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM {orders} GROUP BY CUBE(o_orderstatus, o_orderpriority)",
)
sql_query(
    "d_rollup",
    "SELECT CAST(who AS STRING) AS user_id, event_type, n, high FROM (SELECT user_id AS who, event_type, count(*) AS n, max(value) AS high FROM {events} GROUP BY ROLLUP(user_id, event_type)) r",
)
sql_query(
    "d_grouping_sets",
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS quantity FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
)
sql_query(
    "d_ranks",
    """SELECT event_id, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, round(percent_rank() OVER w, 9) AS percent, round(cume_dist() OVER w, 9) AS cume
    FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""",
)
sql_query(
    "d_range_frame",
    """SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS high
    FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
)
sql_query("d_intersect", "SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'")
sql_query("d_intersect_all", "SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'")
sql_query("d_except", "SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'")
sql_query("d_except_all", "SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'")


@query(
    "d_dates",
    """
    SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY, '%Y-%m-%d') AS due,
        strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS quarter_later, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
        date_diff('day', o_orderdate, DATE '2002-01-01') AS days_left, CAST(isodow(o_orderdate) AS BIGINT) AS weekday
    FROM orders
    """,
)
def dates(spark, sf_dir):
    """Truncation, intervals and differences of dates without a zone."""
    day, text = F.to_date("o_orderdate"), lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text(F.trunc(day, "month")).alias("month"),
        text(day + F.expr("INTERVAL 90 DAYS")).alias("due"),
        text(F.add_months(day, 3)).alias("quarter_later"),
        text(F.last_day(day)).alias("month_end"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).cast("long").alias("days_left"),
        (F.weekday(day) + 1).cast("long").alias("weekday"),
    )


sql_query(
    "d_recursion",
    """WITH RECURSIVE up(n_nationkey, place, depth) AS (
        SELECT n_nationkey, n_nationkey + 1, 0 FROM {nation} UNION ALL SELECT n_nationkey, CAST(floor(place / 2) AS INT), depth + 1 FROM up WHERE place > 1
    ) SELECT n_nationkey, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY n_nationkey""",
)
sql_query(
    "d_approximate",
    # Distinct counts and ranks apart: together, Spark keeps a sketch and a percentile for each part key.
    """WITH c AS (SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM {lineitem} GROUP BY l_returnflag),
    a AS (SELECT l_returnflag, approx_count_distinct(l_partkey) AS near, percentile_approx(l_quantity, 0.5, 10000) AS median, percentile(l_quantity, array(0.48, 0.52)) AS ends FROM {lineitem} GROUP BY l_returnflag)
    SELECT a.l_returnflag, abs(near - n) <= 0.15 * n AS count_near, median BETWEEN ends[0] AND ends[1] AS median_near FROM a JOIN c ON a.l_returnflag <=> c.l_returnflag""",
    "SELECT DISTINCT l_returnflag, TRUE AS count_near, TRUE AS median_near FROM lineitem",
)


@query(
    "d_session_windows",
    """
    WITH b AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR, TRUE) AS new FROM events),
    i AS (SELECT *, sum(new::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, session
    """,
)
def session_windows(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "d_sliding_windows",
    """
    WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start, event_type FROM events)
    SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM w GROUP BY ALL
    """,
)
def sliding_windows(spark, sf_dir):
    windows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return windows.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("d_aggregate_function", "SELECT event_type, round(exp(avg(ln(value + 1))) - 1, 4) AS middle FROM events GROUP BY event_type")
def aggregate_function(spark, sf_dir):
    """An aggregate of one's own as a Pandas function over a few numbers a group: means of logarithms combined by weight,
    after Spark has added up each user's, so that no group is large."""
    ship(spark)

    @pandas_udf("double")
    def combined(total: pd.Series, n: pd.Series) -> float:
        import numpy as np

        return float(np.expm1(total.sum() / n.sum()))

    log = F.log1p("value")
    parts = table(spark, sf_dir, "events").groupBy("event_type", F.pmod("user_id", F.lit(64)).alias("part")).agg(F.sum(log).alias("total"), F.count("*").alias("n"))
    return parts.groupBy("event_type").agg(combined("total", "n").alias("m")).select("event_type", F.round("m", 4).alias("middle"))


@query("d_table_function", "SELECT event_id, CAST(unnest(range(1, CAST(json_extract(props, '$.k') AS BIGINT) % 4 + 1)) AS INTEGER) AS step FROM events")
def table_function(spark, sf_dir):
    """A table function of one's own, over whole batches."""

    @arrow_udtf(returnType="event_id bigint, step int")
    class Steps:
        def eval(self, batch: pa.RecordBatch):
            import numpy as np

            n = batch.column("k").to_numpy(zero_copy_only=False) % 4
            last = np.cumsum(n)
            step = np.arange(1, int(n.sum()) + 1) - np.repeat(last - n, n)
            yield pa.table({"event_id": batch.column("event_id").take(pa.array(np.repeat(np.arange(len(n)), n))), "step": pa.array(step, pa.int32())})

    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return Steps(rows.asTable())


@query("d_csv_source", "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority")
def csv_source(spark, sf_dir):
    """Orders written as CSV and read back with a schema."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return _totals(files.stored(orders, "csv", header=True))


@query("d_orc_source", "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority")
def orc_source(spark, sf_dir):
    """Orders written as ORC and read back."""
    return _totals(files.stored(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "orc"))


def _totals(orders):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), total.alias("total"))


def _numbered(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return R.places(events, ["ts", "event_id"])


@query("w05_row_number_of_all", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal FROM events")
def row_number_of_all(spark, sf_dir):
    return _numbered(spark, sf_dir).select("event_id", "ordinal")


@query("w04_equal_count_buckets_of_all", "SELECT event_id, ntile(96) OVER (ORDER BY ts, event_id) AS bucket FROM events")
def equal_count_buckets_of_all(spark, sf_dir):
    """The first n mod 96 buckets have a row more than the others."""
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    rows = _numbered(spark, sf_dir).crossJoin(n)  # one row
    size, more, at = F.floor(F.col("n") / 96), F.col("n") % 96, F.col("ordinal") - 1
    bucket = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.select("event_id", (bucket + 1).cast("long").alias("bucket"))


@query("w12_successor_of_all", "SELECT n_nationkey, (n_nationkey + 1) % (SELECT count(*) FROM nation) AS successor FROM nation")
def successor_of_all(spark, sf_dir):
    n = table(spark, sf_dir, "nation").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").crossJoin(n).select("n_nationkey", ((F.col("n_nationkey") + 1) % F.col("n")).alias("successor"))  # one row


@query("a08_normalised_power_of_all", "SELECT event_id, round(pow(value / ((SELECT max(value) FROM events) + 1e-6), 0.8), 3) AS level FROM events")
def normalised_power_of_all(spark, sf_dir):
    """The maximum is an aggregate of its own, joined as one row."""
    top = table(spark, sf_dir, "events").agg(F.max("value").alias("top"))
    return table(spark, sf_dir, "events").select("event_id", "value").crossJoin(top).select("event_id", F.round(F.pow(F.col("value") / (F.col("top") + 1e-6), 0.8), 3).alias("level"))


@query(
    "w10_box_of_40",
    """
    SELECT event_id, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS DOUBLE) / 40, 6) AS smooth
    FROM events
    """,
)
def box_of_40(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators.sequences import centred_mean

    mean = centred_mean(F.col("value").cast("decimal(18,2)"), Window.partitionBy("user_id").orderBy("ts", "event_id"), 40)
    return table(spark, sf_dir, "events").select("event_id", F.round(mean.cast("double"), 6).alias("smooth"))
