"""Joins and lookups (J01-J09). The planner picks the strategy; sides are only broadcast by their measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, sql_query, table


def strict_lookup(rows: DataFrame, dimension: DataFrame, left: str, right: str) -> DataFrame:
    """Inner join that fails on a key without partner: the missing keys are counted in the same pass as the rows are made."""
    joined = rows.join(dimension, F.col(left) == F.col(right), "left")
    known = F.when(F.col(right).isNull(), F.raise_error(F.concat(F.lit(f"no partner for {left} "), F.col(left).cast("string")))).otherwise(F.col(right))
    return joined.withColumn(right, known)


@query("j01_strict_inner", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_inner(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return strict_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_name")


@query("j02_dimension_strict", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dimension_strict(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return strict_lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", "n_nationkey").select("c_custkey", "n_name")


sql_query("j03_dimension_default", "SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
sql_query(
    "j04_digest_semi",
    "SELECT o_orderkey FROM {orders} LEFT SEMI JOIN {customer} ON sha2(concat('q|', CAST(o_custkey AS STRING)), 256) = sha2(concat('q|', CAST(c_custkey AS STRING)), 256) AND c_acctbal > 5000",
    "SELECT o_orderkey FROM orders WHERE sha256('q|' || o_custkey) IN (SELECT sha256('q|' || c_custkey) FROM customer WHERE c_acctbal > 5000)",
)
sql_query(
    "j05_missing",
    "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)",
)
sql_query("j05_unlabelled", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
sql_query("j06_grid", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql_query(
    "j07_overlay",
    "SELECT p.page_id, coalesce(b.text, element_at(split(p.url, '/'), -1)) AS name FROM {pages} p LEFT JOIN {benchmark} b ON p.page_id = b.item_id",
    "SELECT p.page_id, coalesce(b.text, string_split(p.url, '/')[-1]) AS name FROM pages p LEFT JOIN benchmark b ON p.page_id = b.item_id",
)


@query(
    "j08_composite_semi",
    """
    WITH p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
    SELECT conv_id, turn FROM p WHERE (pos < 2 AND role = 'user') OR (pos = 1 AND role = 'assistant')
    """,
)
def composite_semi(spark, sf_dir):
    """(role, place) pairs that are expected, as digests; a semi join keeps the turns that match one."""
    from pyspark.sql import Window

    from ..functions.text import digest

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", digest("q", "ord", F.col("role"), place).alias("h"))
    expected = spark.createDataFrame([("user", 0), ("user", 1), ("assistant", 1)], "role string, place int").select(digest("q", "ord", F.col("role"), F.col("place")).alias("h"))
    return rows.join(expected, "h", "left_semi").select("conv_id", "turn")


@query("j09_map_inversion", "SELECT n_regionkey, n_name AS name, CAST(n_nationkey AS INTEGER) AS number FROM nation")
def map_inversion(spark, sf_dir):
    """Each region's map from number to name, turned around and listed again."""
    maps = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    turned = F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"], e["key"])))
    return maps.select("n_regionkey", F.explode(turned).alias("name", "number"))
