"""Traversal of directed edges to a fixed point: levels, reachable pairs, cycles.

All of these are semi-naive: a round follows only what the round before has found, and leaves out what is known already. Each
round is written and read back, so no plan grows with the number of rounds. Edges that leave a hub are dealt over several
keys, and a row that follows a hub is sent to each of these.

edges: src, dst, of one type that can be ordered; other columns are not read. Edges with a null end lead nowhere, repeated
ones do no harm, and a loop is a cycle of one node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import held

#: Edges of one source beyond which it is a hub, and how many of them share a key.
HUB = 50_000


@dataclass
class Graph:
    """edges: src, salt, dst, each once. hubs: src, salts of the sources whose edges are dealt over several salts."""

    edges: DataFrame
    hubs: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, hub: int = HUB) -> Graph:
        rows = held(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
        hubs = held(rows.groupBy("src").count().filter(F.col("count") > hub).select("src", F.ceil(F.col("count") / hub).cast("int").alias("salts")))
        salt = F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")
        return cls(held(rows.join(hubs, "src", "left").select("src", salt.alias("salt"), "dst")), hubs)

    def follow(self, rows: DataFrame, node: str) -> DataFrame:
        """rows with next, once for each edge that leaves their node."""
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        dealt = rows.join(self.hubs.withColumnRenamed("src", "_hub"), F.col(node) == F.col("_hub"), "left").withColumn("_salt", salts).drop("_hub", "salts")
        edges = self.edges.select(F.col("src").alias("_src"), F.col("salt").alias("_at"), F.col("dst").alias("next"))
        return dealt.join(edges, (F.col(node) == F.col("_src")) & (F.col("_salt") == F.col("_at"))).drop("_src", "_at", "_salt")


def levels(edges: DataFrame, seeds: DataFrame, hub: int = HUB) -> DataFrame:
    """node and level: the fewest edges from any of seeds (node) to each node that they reach; a seed's own level is 0."""
    graph = Graph.of(edges, hub)
    found = frontier = held(seeds.select("node").filter("node is not null").distinct().withColumn("level", F.lit(0)))
    level = 0
    while not frontier.isEmpty():
        level += 1
        ends = graph.follow(frontier.select("node"), "node").select(F.col("next").alias("node")).distinct()
        frontier = held(ends.join(found, "node", "left_anti").withColumn("level", F.lit(level)))
        found = found.unionByName(frontier)
    return found


#: Ways from passages that are told to all tasks; more are joined by a shuffle.
TOLD = 200_000


def closure(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """src, dst and hops (the fewest edges between them) of every pair where dst can be reached from src. A node on a cycle
    reaches itself.

    Rounds go on from passages alone, the nodes with edges to and from them. What a node reaches that no edge leads to is
    taken from its passages' ways in one aggregation afterwards, by its own key, so these pairs go through no round.
    """
    graph = Graph.of(edges, hub)
    passages = held(graph.edges.select("src").distinct().join(graph.edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    found = frontier = held(graph.edges.join(passages, "src", "left_semi").select("src", "dst", F.lit(1).alias("hops")))
    hops = 1
    while not frontier.isEmpty():
        hops += 1
        pairs = graph.follow(frontier.select("src", "dst"), "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = held(pairs.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        found = found.unionByName(frontier)
    first = graph.edges.join(passages, "src", "left_anti").select("src", "dst")
    ways = found.select(F.col("src").alias("_at"), F.col("dst").alias("_end"), (F.col("hops") + 1).alias("hops"))
    ways = F.broadcast(ways) if found.limit(TOLD + 1).count() <= TOLD else ways
    further = first.repartition("src").join(ways, F.col("dst") == F.col("_at"), "left")
    ends = F.array(F.struct("dst", F.lit(1).alias("hops")), F.struct(F.col("_end").alias("dst"), "hops"))
    reached = further.select("src", F.explode(ends).alias("_x")).select("src", "_x.dst", "_x.hops").filter("dst is not null")
    return found.unionByName(reached.groupBy("src", "dst").agg(F.min("hops").alias("hops")))


def cycles(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """node and component of every node on a cycle. Nodes that reach each other share a component, named by its smallest node.

    Nodes without an edge to or from another that is left are peeled off, again and again. Every node that stays takes the
    greatest node that leads to it as its colour; what leads to a colour's own node within the colour is its component. The
    components are taken out, and so on until nothing is left: pairs of nodes are never made.
    """
    left = held(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    node = left.schema["src"].dataType.simpleString()
    found = edges.sparkSession.createDataFrame([], f"node {node}, component {node}")
    while True:
        left = _peeled(left)
        if left.isEmpty():
            return found
        colours = _colours(left, hub)
        ends = left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("_one")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("_two")), "dst")
        inside = ends.filter("_one = _two").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = levels(inside, colours.filter("node = colour"), hub).select("node").join(colours, "node")
        named = held(members.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")))
        members = held(members.join(named, "colour").select("node", "component", "n"))
        loops = left.filter("src = dst").select(F.col("src").alias("node")).withColumn("loop", F.lit(True))
        found = found.unionByName(held(members.join(loops, "node", "left").filter("n > 1 or loop").select("node", "component")))
        gone = members.select("node")
        left = held(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have one to and one from a node that stays."""
    n = edges.count()
    while n:
        ends = held(edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi"))
        kept = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
        edges, before = held(kept.select("src", "dst")), n
        n = edges.count()
        if n == before:
            break
    return edges


def _colours(edges: DataFrame, hub: int) -> DataFrame:
    """node and colour: the greatest node that leads to it, or itself."""
    graph = Graph.of(edges, hub)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = changed = held(nodes.withColumn("colour", F.col("node")))
    while True:
        told = graph.follow(changed, "node").groupBy("next").agg(F.max("colour").alias("told"))
        changed = held(told.join(state, F.col("next") == F.col("node")).filter("told > colour").select("node", F.col("told").alias("colour")))
        if changed.isEmpty():
            return state
        state = held(state.join(changed.withColumnRenamed("colour", "told"), "node", "left").select("node", F.coalesce("told", "colour").alias("colour")))
