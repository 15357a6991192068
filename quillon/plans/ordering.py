"""Sort, limit and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, sql_query, table

sql_query("o01_sorted", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderdate, o_orderkey")


@query(
    "o02_first_match",
    "SELECT o_orderkey, (SELECT CAST(min(l_linenumber) AS VARCHAR) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS first_line FROM orders",
)
def first_match(spark, sf_dir):
    """First line that matches, else null."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("string").alias("first_line"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "first_line")


@query(
    "o03_limit_with_rest",
    """
    WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY i) AS shown, greatest(max(n) - 4, 0) AS more FROM r WHERE i <= 4 GROUP BY l_orderkey
    """,
)
def limit_with_rest(spark, sf_dir):
    """The first four lines of each order and how many more there are."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").withColumn("i", place)
    first = F.sort_array(F.collect_list(F.when(F.col("i") <= 4, F.col("l_linenumber"))))
    more = F.greatest(F.max("i") - 4, F.lit(0)).cast("long")
    return rows.groupBy("l_orderkey").agg(F.array_join(first.cast("array<string>"), ",").alias("shown"), more.alias("more"))


@query("o06_concatenation", "SELECT event_id, 'view' AS part FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'high' AS part FROM events WHERE value > 200")
def concatenation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    part = lambda keep, name: events.filter(keep).select("event_id", F.lit(name).alias("part"))
    return part("event_type = 'view'", "view").unionByName(part("value > 200", "high"))


sql_query("o07_distinct", "SELECT DISTINCT p_brand, p_type FROM {part}")
sql_query(
    "o08_padded_rows",
    "SELECT r.r_regionkey, CAST(p.place AS BIGINT) AS place, n.n_name FROM {region} r CROSS JOIN (SELECT explode(sequence(1, 8)) AS place) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM {nation}) n ON n.n_regionkey = r.r_regionkey AND n.i = p.place",
    "SELECT r.r_regionkey, CAST(p.place AS BIGINT) AS place, n.n_name FROM region r CROSS JOIN (SELECT unnest(range(1, 9)) AS place) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) n ON n.n_regionkey = r.r_regionkey AND n.i = p.place",
)
