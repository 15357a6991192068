"""Aggregations (A01-A13). Money is summed as decimals, so sums do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, sql_query, table

sql_query(
    "a01_grouped_sums",
    "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS low, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS high FROM {lineitem} GROUP BY l_orderkey",
)
sql_query(
    "a02_conditional_counts",
    "SELECT o_custkey, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS right_ones, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS blanks, count(*) AS total FROM {orders} GROUP BY o_custkey",
)


@query(
    "a03_every",
    "SELECT c_custkey, coalesce(bool_and(o_orderstatus <> 'P'), TRUE) AS every_solved FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
)
def every(spark, sf_dir):
    """A customer without orders has nothing open: true, where bool_and over no rows is null."""
    solved = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("all_solved"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(solved, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("all_solved", F.lit(True)).alias("every_solved"))


@query(
    "a04_groups_hit",
    """
    WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents)
    SELECT doc_id, list_has_any(w, ['the', 'der', 'la']) AND list_has_any(w, ['of', 'und', 'que']) AS both_groups FROM t
    """,
)
def groups_hit(spark, sf_dir):
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]+", " "), " "), lambda w: w != "")
    hit = lambda *g: F.arrays_overlap("w", F.array(*[F.lit(x) for x in g]))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", (hit("the", "der", "la") & hit("of", "und", "que")).alias("both_groups"))


@query("a05_distinct_sorted", "SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM part GROUP BY p_type")
def distinct_sorted(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return pairs.groupBy("p_type").agg(F.array_join(F.sort_array(F.collect_list("p_brand")), ",").alias("brands"))


sql_query("a06_extent", "SELECT user_id, event_type, min(value) AS low, max(value) AS high FROM {events} GROUP BY user_id, event_type")
sql_query(
    "a07_percentile",
    "SELECT user_id, round(percentile(abs(value), 0.95), 6) AS p95 FROM {events} GROUP BY user_id",
    "SELECT user_id, round(quantile_cont(abs(value), 0.95), 6) AS p95 FROM events GROUP BY user_id",
)


@query("a08_normalised_power", "SELECT event_id, round(pow(value / (max(value) OVER (PARTITION BY user_id) + 1e-6), 0.8), 3) AS level FROM events")
def normalised_power(spark, sf_dir):
    top = F.max("value").over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.pow(F.col("value") / (top + 1e-6), 0.8), 3).alias("level"))


@query("a09_axis_mean", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS mean FROM embeddings")
def axis_mean(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total / F.size("embedding"), 6).alias("mean"))


@query(
    "a10_fold_with_flags",
    """
    WITH o AS (SELECT user_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again, event_type = 'error' AS bad FROM events)
    SELECT user_id, count(*) AS n, CAST(count_if(coalesce(again, FALSE)) AS BIGINT) AS repeats, bool_or(bad) AS any_error FROM o GROUP BY user_id
    """,
)
def fold_with_flags(spark, sf_dir):
    """Each event sees the kind before it; counts and flags are then combined before the shuffle is over. No user's events
    are ever held as one array."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_type") == F.lag("event_type").over(order)).alias("again"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("again").alias("repeats"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


sql_query("a11_invalid_count", "SELECT l_returnflag, CAST(count_if(l_quantity <= 0 OR l_discount > 0.09) AS BIGINT) AS invalid FROM {lineitem} GROUP BY l_returnflag")
sql_query("a12_open_counts", "SELECT o_orderpriority, count(*) AS total, CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS open FROM {orders} GROUP BY o_orderpriority")
sql_query(
    "a13_transcript",
    r"SELECT conv_id, sha2(listagg(concat(role, ': ', text), '\n') WITHIN GROUP (ORDER BY turn), 256) AS transcript_sha256 FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript_sha256 FROM conversations GROUP BY conv_id",
)
