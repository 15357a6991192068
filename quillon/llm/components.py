"""Connected components of an edge list, by alternating large-star and small-star steps.

Each round is two joins and two aggregations over the edges; rounds grow with the logarithm of the longest path.
The minima of nodes are combined before the shuffle and written, so that both sides of a join are plain tables: then Spark
splits the edges of a node that has very many of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another one but the roots; root is the smallest node reachable.

    edges: a, b, of one type that can be ordered. Loops and repeated edges do no harm. Rounds go on until nothing changes,
    which every round but the last brings nearer, as no node ever gets a larger neighbour.
    """
    up, down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.filter("a <> b").select(up, down).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least-neighbours")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least-above")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]
