"""Joins on two inequalities, without a nested loop over all pairs of rows.

1. Each side is range-partitioned by its first attribute, and a partition is cut in blocks of the second one's order. The
   smallest and the largest value of both attributes are known of each block, so most pairs of blocks are ruled out: a few
   very long intervals only make few blocks wide. Where there are many blocks, their bounds are joined in this same way.
2. The pairs of blocks that are left are tasks. A task joins by sorted orders: right rows are sorted by either attribute, and
   a permutation leads from the second order to the first. Left rows come in the order of the second attribute; right rows
   whose second attribute fits are marked in a bit array in the first order, where those whose first attribute fits lie in a
   row. So each left row reads a stretch of the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import held
from ..functions.shipping import ship

OPERATORS = ("<", "<=", ">", ">=")
#: Rows of a block; a task makes the square of it at most.
BLOCK = 1_024
#: Blocks of a side whose bounds the driver compares.
FEW = 2_048


def matches(one: np.ndarray, two: np.ndarray, x: np.ndarray, y: np.ndarray, first: str, second: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) where `one first x` and `two second y` hold, left row by left row. NaN is larger than any number."""
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    place = np.empty(len(x), np.int64)
    place[by_x] = np.arange(len(x))
    permutation = place[by_y]  # from the second order to the first
    # Of the first order: l < x takes the rows after the last x <= l, l > x those before the first x >= l.
    cut_x = np.searchsorted(x[by_x], one, side={"<": "right", "<=": "left", ">": "left", ">=": "right"}[first])
    cut_y = np.searchsorted(y[by_y], two, side={"<": "right", "<=": "left", ">": "left", ">=": "right"}[second])
    low, high = (cut_x, np.full(len(one), len(x))) if first[0] == "<" else (np.zeros(len(one), np.int64), cut_x)
    upward = second[0] == ">"  # right rows fit from the smallest on
    order = np.argsort(cut_y if upward else -cut_y, kind="stable")
    marks = np.zeros(len(x), bool)
    done = 0 if upward else len(y)
    for i in order.tolist():
        cut = int(cut_y[i])
        if upward and cut > done:
            marks[permutation[done:cut]] = True
            done = cut
        elif not upward and cut < done:
            marks[permutation[cut:done]] = True
            done = cut
        hit = np.flatnonzero(marks[low[i] : high[i]])
        if len(hit):
            yield np.full(len(hit), i), by_x[hit + low[i]]


def _blocks(df: DataFrame, first: str, second: str, block: int, parts: int) -> DataFrame:
    """Written: block, _a, _b and row (all columns) of the rows of df without nulls in the attributes."""
    rows = df.select(F.col(first).alias("_a"), F.col(second).alias("_b"), F.struct("*").alias("row")).filter("_a is not null and _b is not null")
    # A hash of the row deals out rows of one value.
    ordered = rows.repartitionByRange(parts, "_a", F.xxhash64(F.to_json("row"))).sortWithinPartitions("_b").withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    label = (F.shiftleft(part, 33) + F.floor(place / block)).cast("bigint")
    return held(ordered.select(label.alias("block"), "_a", "_b", "row"))


def _bounds(blocks: DataFrame, first: str, second: str, left: bool, names: list[str]) -> DataFrame:
    """Of each block, the value of either attribute that matches most: a block pair has a match only if these match."""
    most = [F.min(c) if (op[0] == "<") == left else F.max(c) for c, op in (("_a", first), ("_b", second))]
    found = blocks.groupBy("block").agg(*[m.alias(n) for m, n in zip(most, names[1:])])
    return held(found.withColumnRenamed("block", names[0]))


def _meeting(left: list, right: list, first: str, second: str) -> list[tuple[int, int]]:
    """Of rows (block, value, value) of either side, the pairs of blocks whose values match."""
    can = np.ones((len(left), len(right)), bool)
    for c, op in ((1, first), (2, second)):
        sides = [[r[c] for r in rows] for rows in (left, right)]
        ranks = {v: i for i, v in enumerate(sorted({*sides[0], *sides[1]}, key=lambda v: (isinstance(v, float) and v != v, v)))}
        own, other = (np.array([ranks[v] for v in vs], np.int64) for vs in sides)
        can &= {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[op](own[:, None], other[None, :])
    return [(left[i][0], right[j][0]) for i, j in zip(*(x.tolist() for x in np.nonzero(can)))]


def _block_pairs(ours: DataFrame, theirs: DataFrame, first: str, second: str, block: int, few: int) -> DataFrame:
    """one, two: the pairs of blocks that may hold a match. Up to `few` blocks a side are compared on the driver; more of them
    are rows of a join like this one, a thousandth of the size."""
    one, two = _bounds(ours, first, second, True, ["one", "_l1", "_l2"]), _bounds(theirs, first, second, False, ["two", "_r1", "_r2"])
    n = max(one.count(), two.count())
    if n > few:
        return held(inequality_join(one, two, ("_l1", first, "_r1"), ("_l2", second, "_r2"), block, few, max(1, n // block)).select("one", "two"))
    met = _meeting(one.collect(), two.collect(), first, second)
    return held(ours.sparkSession.createDataFrame(met, "one bigint, two bigint"))


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """Values in their order; dates and times as whole numbers, decimals and texts as Python's."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    if pa.types.is_temporal(column.type):
        column = column.cast(pa.int64())
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy()
    values = np.empty(len(column), object)
    values[:] = column.to_pylist()
    return values


def inequality_join(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], block: int = BLOCK, few: int = FEW, parts: int | None = None) -> DataFrame:
    """Pairs of a row of left and one of right for which both inequalities hold, with all columns of both.

    first, second: (column of left, one of < <= > >=, column of right). Columns of the two sides must differ in name. A null
    attribute matches nothing; NaN is larger than any number and equal to itself, as everywhere in Spark. Rows that repeat
    match as often as they stand. Where a side is empty, there are no rows. parts: range partitions of a side; as many as Spark
    shuffles to, if not given.
    """
    spark = left.sparkSession
    ship(spark)
    (a, op_a, x), (b, op_b, y) = first, second
    if op_a not in OPERATORS or op_b not in OPERATORS:
        raise ValueError(f"only {', '.join(OPERATORS)} can be joined on")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ours, theirs = _blocks(left, a, b, block, parts), _blocks(right, x, y, block, parts)
    pairs = _block_pairs(ours, theirs, op_a, op_b, block, few)
    names = [*left.columns, *right.columns]

    def join(one: pa.Table, two: pa.Table) -> pa.Table:
        found = list(matches(*(_values(t[c]) for t in (one, two) for c in ("_a", "_b")), op_a, op_b)) if one.num_rows and two.num_rows else []
        at = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
        flat = [t["row"].combine_chunks() if t.num_rows else t["row"].combine_chunks().slice(0, 0) for t in (one, two)]
        columns = [c for rows, i in zip(flat, at) for c in (rows.chunk(0) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows).take(pa.array(i)).flatten()]
        return pa.Table.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*left.schema.fields, *right.schema.fields])
    one = ours.join(pairs.select(F.col("one").alias("block"), F.col("one").alias("_one"), F.col("two").alias("_two")), "block").drop("block")
    two = theirs.join(pairs.select(F.col("two").alias("block"), F.col("one").alias("_first"), F.col("two").alias("_second")), "block").drop("block")
    return one.groupBy("_one", "_two").cogroup(two.groupBy("_first", "_second")).applyInArrow(join, schema)
