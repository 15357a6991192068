"""Counts and extremes over the matches of two inequalities, without the matches.

Pairs of a join on two inequalities, or on a range, grow with the square of the rows; counts, least and greatest values of
them need none. Both sides are put in one order by the first attribute and in one by the second, and of these orders only the
places go on. A row's fitting rows lie behind it in the first order: a suffix, which is the union of at most one half of a
stretch of 2^k places for each k. So each row is written once for about half of the levels k, and within a stretch one running
aggregate in the second order gives each row what it asks for. The work is n log n, and no task holds more than 2^WIDE places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import held
from .inequality import OPERATORS
from .ranges import places

#: Logarithm of the places of the second order that one window covers.
WIDE = 18


def inequality_aggregate(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], values: dict[str, tuple[Callable[[Column], Column], str]], wide: int = WIDE) -> DataFrame:
    """Rows of right that match a row of left, with n, the number of their matches, and values over these.

    first, second: (column of left, one of < <= > >=, column of right); both may name the same column of left. values: by name,
    F.min or F.max and a column of left. Nulls match nothing; NaN is larger than any number and equal to itself, as everywhere
    in Spark. Rows that repeat count as often as they stand.
    """
    (a, op_a, x), (b, op_b, y) = first, second
    if op_a not in OPERATORS or op_b not in OPERATORS:
        raise ValueError(f"only {', '.join(OPERATORS)} can be joined on")
    over = {name: f for name, (f, _) in values.items()}
    points = left.select(F.col(a).alias("_a"), F.col(b).alias("_b"), *[F.col(c).alias(name) for name, (_, c) in values.items()]).filter("_a is not null and _b is not null")
    points = points.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"), *[f(F.col(name)).alias(name) for name, f in over.items()])
    asked = right.select(F.col(x).alias("_a"), F.col(y).alias("_b")).filter("_a is not null and _b is not null").distinct()
    # Where values are equal, what fits stands on the side of what fits.
    ahead = lambda op, point: F.lit(int(point != (op in (">", "<="))))
    both = held(points.withColumn("_point", F.lit(1)).unionByName(asked.withColumn("_point", F.lit(0)), allowMissingColumns=True))
    tied = both.withColumn("_one", F.when(F.col("_point") == 1, ahead(op_a, True)).otherwise(ahead(op_a, False))).withColumn("_two", F.when(F.col("_point") == 1, ahead(op_b, True)).otherwise(ahead(op_b, False)))
    placed = places(places(tied, ["_a", "_one", "_b"], "_p"), ["_b", "_two", "_a"], "_s")
    total = both.count()
    # What fits stands behind in the first order and before in the second.
    p, s = (F.lit(total) - F.col("_p") if op_a[0] == "<" else F.col("_p") - 1), (F.col("_s") - 1 if op_b[0] == "<" else F.lit(total) - F.col("_s"))
    placed = held(placed.withColumn("_p", p).withColumn("_s", s).drop("_one", "_two"))

    depth = max(1, (total - 1).bit_length())
    names = ["n", *over]
    sum_up = lambda c: [F.sum("n").alias("n"), *[f(F.col(name)).alias(name) for name, f in over.items()]] if c is None else [F.sum("n").over(c).alias("n"), *[f(F.col(name)).over(c).alias(name) for name, f in over.items()]]
    level = F.expr(f"explode(filter(sequence(0, {depth - 1}), k -> (shiftright(_p, k) & 1) = _point))")
    rows = placed.select("_point", "_p", "_s", *names, level.alias("_k")).withColumn("_half", F.expr("shiftright(_p, _k + 1)")).withColumn("_part", F.expr(f"if(_k < {wide}, 0L, shiftright(_s, {wide}))"))
    group = ["_k", "_half"]
    before = Window.partitionBy(*group, "_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("_point", "_p", *sum_up(before)).filter("_point = 0").drop("_point")
    if depth > wide:  # stretches in several parts: what the parts before hold is added
        high = rows.filter(f"_k >= {wide}")
        parts = high.groupBy(*group, "_part").agg(*sum_up(None))
        earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = parts.select(*group, "_part", *sum_up(earlier)).filter("n > 0")
        found = found.unionByName(high.filter("_point = 0").select("_p", *group, "_part").join(carried, [*group, "_part"]).select("_p", *names))
    found = found.groupBy("_p").agg(*sum_up(None)).filter("n > 0")
    answers = placed.filter("_point = 0").select("_p", "_a", "_b").join(found, "_p").drop("_p")
    return right.join(answers, (F.col(x) == F.col("_a")) & (F.col(y) == F.col("_b"))).drop("_a", "_b")
