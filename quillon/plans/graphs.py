"""Traversal of the edges between pages (M17): beyond the reference, which derives edges but follows none.

The first word of a page's heading links to the words that its paths name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from .registry import query, table

_EDGES = """e AS (SELECT DISTINCT src, dst FROM (
        SELECT regexp_extract(html, '<h1>([^ <]+)', 1) AS src, unnest(regexp_extract_all(html, '<a href="/([^"/]*)"', 1)) AS dst FROM pages
    ) WHERE src <> '' AND dst <> '')"""
#: Walks of up to 24 steps; in all of the tables the longest of the shortest ways has 9.
_PAIRS = f"""{_EDGES}, walks(src, dst, hops) AS (
        SELECT src, dst, 1 FROM e UNION SELECT walks.src, e.dst, hops + 1 FROM walks JOIN e ON walks.dst = e.src WHERE hops < 24
    ), pairs AS (SELECT src, dst, min(hops) AS hops FROM walks GROUP BY src, dst)"""


def word_edges(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<h1>([^ <]+)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"/]*)"'), F.lit(1))).alias("dst"))
    return pages.filter("src <> '' and dst <> ''")


@query(
    "m17_levels",
    f"""
    WITH RECURSIVE {_EDGES}, walks(node, level) AS (
        SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM walks JOIN e ON walks.node = e.src WHERE level < 24
    ) SELECT node, CAST(min(level) AS BIGINT) AS level FROM walks GROUP BY node
    """,
)
def link_levels(spark, sf_dir):
    """How many links lead to each word from words to which none leads."""
    edges = word_edges(spark, sf_dir)
    seeds = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return G.levels(edges, seeds).withColumn("level", F.col("level").cast("bigint"))


@query("m17_reachable", f"WITH RECURSIVE {_PAIRS} SELECT src, dst, CAST(hops AS BIGINT) AS hops FROM pairs")
def reachable_words(spark, sf_dir):
    return G.closure(word_edges(spark, sf_dir)).withColumn("hops", F.col("hops").cast("bigint"))


@query("m17_cycles", f"WITH RECURSIVE {_PAIRS} SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM pairs a JOIN pairs b ON a.dst = b.src AND a.src = b.dst GROUP BY a.src")
def words_on_cycles(spark, sf_dir):
    return G.cycles(word_edges(spark, sf_dir))
