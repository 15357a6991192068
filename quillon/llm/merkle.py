"""Merkle manifest of a table: one root digest over all rows, and for each row the siblings that lead from it to the root.

Every group of rows has a tree of its own, whose leaves are digests of rows in order; the roots of the groups are the leaves
of one tree above them. A node is the digest of up to `arity` consecutive ones, as hex text.

1. Rows are range-partitioned by group and order and written with their place in their partition; rows counted by partition
   and group then give every row its index, and every tree its size. So the arity of each sibling run is known.
2. A forest is a set of nodes by tree, level and index whose runs are not complete. Forests are added by putting their nodes
   together: whenever a run is complete, its parent takes its place, and so on upwards. That is associative, and the empty
   forest changes nothing. A partition of consecutive rows leaves at most a run at either end of each level, so forests stay
   small whatever they cover; neighbouring ones are added up by `FAN` until one is left, which holds the root alone.
3. Complete runs are rows of written tables. From the root downwards each run takes over the path of the run above it, by
   joins in which no key has more than `arity` rows; the runs of leaves then have all that their rows need.

Forests are added by grouped tasks and written after each round, not sent to the driver: the runs that complete on the way
are needed for the proofs, and a lost executor repeats a part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .memory import given_back
from .store import written

ARITY = 16
#: Neighbouring forests that are added in one task.
FAN = 16
#: The tree over the roots of the groups.
_TOP = -1
_NAMES = ["part", "tree", "level", "at", "total", "open", "nodes", "ids", "shown"]


def leaf(*columns: Column) -> Column:
    """SHA-256 in hex of the values in a row: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def parent(nodes: list[bytes]) -> bytes:
    return sha256("".join([n.hex() for n in nodes]).encode()).digest()


def root_from(leaf_hex: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf leads to. proof: from the leaf upwards, the place in each run and its other nodes, in hex."""
    for at, others in proof:
        leaf_hex = sha256("".join([*others[:at], leaf_hex, *others[at:]]).encode()).hexdigest()
    return leaf_hex


class Forest:
    """Nodes whose sibling runs are not complete, by tree, level and run. total: leaves of each tree."""

    def __init__(self, trees: int, arity: int = ARITY):
        self.arity, self.total = arity, {_TOP: trees}
        self.open: dict[tuple[int, int, int], dict[int, tuple]] = {}
        self.done: list[tuple] = []

    def add(self, tree: int, level: int, index: int, digest: bytes, own: tuple | None = None) -> None:
        """own: what the row of a leaf carries."""
        while True:
            width = -(-self.total[tree] // self.arity**level)
            if width == 1 and tree == _TOP:
                self.open[tree, level, 0] = {0: (digest, None)}
                return
            if width == 1:
                if level == 0:  # a lone leaf is the root of its tree
                    self.done.append((tree, 0, 0, digest, [own]))
                tree, level, index, own = _TOP, 0, tree, None
                continue
            run, slot = divmod(index, self.arity)
            held = self.open.setdefault((tree, level, run), {})
            held[slot] = (digest, own)
            if len(held) < min(self.arity, width - run * self.arity):
                return
            del self.open[tree, level, run]
            nodes = [held[i][0] for i in range(len(held))]
            self.done.append((tree, level, run, b"".join(nodes), [held[i][1] for i in range(len(held))] if level == 0 and tree != _TOP else None))
            digest, level, index, own = parent(nodes), level + 1, run, None

    def taken(self, part: int, whole: bool) -> list[tuple]:
        """Rows of the complete runs, which the forest forgets; with whole, of the open nodes too."""
        rows = [(part, t, level, at, self.total[t], False, nodes, *(zip(*own) if own else (None, None))) for t, level, at, nodes, own in self.done]
        self.done = []
        if whole:
            for (t, level, run), held in self.open.items():
                rows += [(part, t, level, run * self.arity + slot, self.total[t], True, digest, *(([x] for x in own) if own else (None, None))) for slot, (digest, own) in held.items()]
            self.open = {}
        return rows


def _leaves(docs: DataFrame, columns: list[str], group: str, order: str, shown: Column) -> DataFrame:
    """Written: part, at (place in it), g, id, leaf and shown (both binary) of every row, in the order of group, id and leaf.

    Rows equal in all of these are dealt by where they were read, so that many of them need not share a task.
    """
    by = (F.asc_nulls_first("g"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("read"))
    own = leaf(*[F.col(f"`{c}`") for c in columns])
    rows = docs.select(F.col(group).alias("g"), F.col(order).alias("id"), F.unhex(own).alias("leaf"), F.unhex(shown).alias("shown")).withColumn("read", F.monotonically_increasing_id())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    part = F.shiftright("place", 33)
    return written(placed.select(part.alias("part"), (F.col("place") - F.shiftleft(part, 33)).alias("at"), "g", "id", "leaf", "shown"), "manifest-leaves")


def _sizes(leaves: DataFrame) -> DataFrame:
    """Written: for each part and group in it, its first place, the rows of the group before it (base), all its rows (total),
    the group's number (tree) and whether the group begins there. Windows see a row for each part and group, or each part."""
    counts = leaves.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    upward = Window.partitionBy("g").orderBy("part")
    counts = counts.select(
        "part", "g", "first", F.sum("n").over(Window.partitionBy("g")).alias("total"),
        F.coalesce(F.sum("n").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), (F.row_number().over(upward) == 1).alias("begins"),
    )
    counts = written(counts, "manifest-counts")
    begun = counts.groupBy("part").agg(F.count_if("begins").alias("n"))
    before = begun.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("g"))) - 1
    numbered = counts.filter("begins").join(before, "part").select(F.col("g").alias("group"), (F.col("before") + number).alias("tree"))
    return written(counts.join(numbered, F.col("g").eqNullSafe(F.col("group"))).drop("group"), "manifest-sizes")


def _added(rows: DataFrame, trees: int, arity: int, id_type: str) -> DataFrame:
    """Written: nodes of rows (part, tree, level, at, total, nodes, ids, shown; one node each) added up by part: complete runs
    and open nodes. Rows of a part lie in one task next to each other, or else their forests meet in the next round."""
    schema = f"part bigint, tree bigint, level int, at bigint, total bigint, open boolean, nodes binary, ids array<{id_type}>, shown array<binary>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part, kinds, rows = Forest(trees, arity), None, None, []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)
            rows.clear()
            return batch

        for batch in batches:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), batch.column(6).type, pa.list_(pa.binary())]
            for p, tree, level, at, total, node, ids, shown in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if p != part:
                    rows += forest.taken(part, True)
                    part = p
                forest.total[tree] = total
                forest.add(tree, level, at, node, (ids[0], shown[0]) if ids is not None else None)
                if len(forest.done) >= 500:
                    rows += forest.taken(part, False)
                if len(rows) >= 1_000:
                    yield out()
        rows += forest.taken(part, True)
        if rows:
            yield out()

    ordered = rows.select("part", "tree", "level", "at", "total", "nodes", "ids", "shown").sortWithinPartitions("part", "tree", "level", "at")
    return written(ordered.mapInArrow(lambda batches: given_back(add(batches)), schema), "manifest-runs")


def _levels(total: int, arity: int) -> int:
    """Levels of runs in a tree of that many leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // arity), n + 1
    return n


def _paths(runs: DataFrame, upper: DataFrame, trees: int, largest: int, arity: int) -> DataFrame:
    """tree, at, total, nodes, ids, shown and path of every run of leaves. path: from below, the runs above it that it leads
    through, as place and nodes."""
    none = F.array().cast("array<struct<slot:int,nodes:binary>>")
    slot = lambda c: F.pmod(c, F.lit(arity)).cast("int")

    def below(rows: DataFrame, node: Column, over: DataFrame, same: Column) -> DataFrame:
        """rows with path, where node is their parent's place among the runs of over."""
        over = over.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("nodes").alias("_nodes"), F.col("path").alias("_path"))
        through = F.concat(F.array(F.struct(slot(node).alias("slot"), F.col("_nodes").alias("nodes"))), F.col("_path"))
        return rows.join(over, same & (F.floor(node / arity) == F.col("_at"))).withColumn("path", through).drop("_tree", "_at", "_nodes", "_path")

    highest = None  # runs of the tree over the groups, by level
    for level in range(_levels(trees, arity) - 1, -1, -1):
        own = upper.filter((F.col("tree") == _TOP) & (F.col("level") == level))
        highest = own.withColumn("path", none) if highest is None else below(own, F.col("at"), highest, F.lit(True))
    found = None
    for level in range(max(1, _levels(largest, arity)) - 1, -1, -1):
        own = (upper if level else runs).filter((F.col("tree") != _TOP) & (F.col("level") == level))
        last = F.col("total") <= arity ** (level + 1)
        top = own.filter(last)
        top = top.withColumn("path", none) if highest is None else below(top, F.col("tree"), highest, F.lit(True))
        found = top if found is None else top.unionByName(below(own.filter(~last), F.col("at"), found, F.col("tree") == F.col("_tree")))
    return found


def proofs(docs: DataFrame, columns: list[str], group: str, order: str, presented: Column | None = None, arity: int = ARITY, paths: bool = False) -> DataFrame:
    """For every row of docs: id (its `order` column), leaf, subroot (root of its group), root, proof_sha256 (of all siblings in
    hex, level by level, left to right), folded_root (the root that `presented`, or else the leaf, leads to with these
    siblings) and verified (whether that is the root). With paths, also proof: what root_from takes.

    columns: what a leaf digests, in order; other columns are not read, whatever their names. presented: a digest in hex that
    someone shows for the row; null stands for the leaf itself.

    Leaves ascend by `order`, null first; where it repeats, by their digests, so that rows of one order value have proofs of
    their own and rows equal in everything are different leaves of one digest. A null group is a group and comes first. Null
    and empty texts have different leaves; the length of a text plays no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[order].dataType.simpleString()
    leaves = _leaves(docs, columns, group, order, F.lit(None).cast("string") if presented is None else presented)
    sizes = _sizes(leaves)
    known = sizes.agg(F.count_if("begins").alias("trees"), F.max("total").alias("largest"), F.max("part").alias("parts")).first()
    if not known["trees"]:
        return _finished(spark.createDataFrame([], f"tree bigint, at bigint, total bigint, nodes binary, ids array<{id_type}>, shown array<binary>, path array<struct<slot:int,nodes:binary>>"), "", 0, id_type, paths)
    trees, parts = known["trees"], known["parts"]
    same = (F.col("g").eqNullSafe(F.col("_g"))) & (F.col("part") == F.col("_part"))
    sizes = sizes.select(F.col("part").alias("_part"), F.col("g").alias("_g"), "first", "base", "total", "tree")
    placed = leaves.join(sizes, same).select("part", "tree", F.lit(0).alias("level"), (F.col("base") + F.col("at") - F.col("first")).alias("at"), "total", F.col("leaf").alias("nodes"), F.array("id").alias("ids"), F.array("shown").alias("shown"))
    forests = _added(placed, trees, arity, id_type)
    found = forests.filter("not open")
    while True:  # once at least, as rows of one part may have been read by two tasks
        parts //= FAN
        open_ = forests.filter("open").withColumn("part", F.floor(F.col("part") / FAN).cast("bigint"))
        forests = _added(open_.repartition("part"), trees, arity, id_type)
        found = found.unionByName(forests.filter("not open"))
        if not parts:
            break
    final = forests.filter("open").select("tree", "nodes").limit(2).collect()
    if len(final) != 1 or final[0]["tree"] != _TOP:
        raise RuntimeError("runs of the manifest are incomplete")
    upper = written(found.filter(f"level > 0 or tree = {_TOP}").select("tree", "level", "at", "total", "nodes", "ids", "shown"), "manifest-upper-runs")
    rows = _paths(found.select("tree", "level", "at", "total", "nodes", "ids", "shown"), upper, trees, known["largest"], arity)
    return _finished(rows, bytes(final[0]["nodes"]).hex(), _levels(trees, arity), id_type, paths)


def _finished(rows: DataFrame, root: str, top_levels: int, id_type: str, paths: bool) -> DataFrame:
    """Result rows from runs of leaves with their paths. top_levels: how many steps of a path lie above the groups' roots."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * paths]

    def split(nodes: bytes) -> list[str]:
        text = nodes.hex()
        return [text[i : i + 64] for i in range(0, len(text), 64)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda *texts: sha256("".join(texts).encode()).hexdigest()
        for batch in batches:
            kinds = [batch.column(2).type.value_type, *[pa.string()] * 5, pa.bool_(), pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))]
            made = []
            for total, nodes, ids, shown, path in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own, steps = split(nodes), [(p["slot"], split(p["nodes"])) for p in path]
                sides = [("".join(n[:at]), "".join(n[at + 1 :])) for at, n in steps]
                above = "".join([left + right for left, right in sides])
                subroot = steps[-top_levels][1][steps[-top_levels][0]] if top_levels else root

                def folded(i: int, start: str) -> str:
                    x = start if total == 1 else digest(*own[:i], start, *own[i + 1 :])
                    for left, right in sides:
                        x = digest(left, x, right)
                    return x

                true = folded(0, own[0])
                for i, (key, other) in enumerate(zip(ids, shown)):
                    start = own[i] if other is None else other.hex()
                    got = true if start == own[i] else folded(i, start)
                    proof = [{"at": at, "others": n[:at] + n[at + 1 :]} for at, n in ([] if total == 1 else [(i, own)]) + steps] if paths else None
                    made.append((key, own[i], subroot, root, digest(*own[:i], *own[i + 1 :], above), got, got == root, proof)[: len(names)])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<struct<at:int,others:array<string>>>" * paths
    return rows.select("total", "nodes", "ids", "shown", "path").mapInArrow(lambda batches: given_back(finish(batches)), schema)
