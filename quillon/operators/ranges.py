"""Joins on ranges and on order, and places in a whole table, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import held


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Pairs of a point and an interval with low <= at <= high, all columns of both.

    Numbers are cut in bins, and the join is then one of equal bins, which is dealt out. Bins follow the intervals: those of
    up to 2^k in length lie in bins of that width, so each touches two or three of them, however long it is, and a point lies in
    one bin of each width that occurs. There are at most as many widths as a double has exponents. Nulls and NaN meet nothing.

    width: one width for all, where the intervals are known to be of about that length.
    """
    spans = intervals.filter((F.col(low) <= F.col(high)) & ~F.isnan(F.col(high).cast("double")))
    known = points.filter(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double")))
    if width is not None:
        bin_of = lambda c: F.floor(F.col(c) / F.lit(float(width)))
        left = known.withColumn("_bin", bin_of(at))
        right = spans.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
        return left.join(right, "_bin").filter(F.col(at).between(F.col(low), F.col(high))).drop("_bin")
    length = F.col(high).cast("double") - F.col(low).cast("double")
    # Bins so narrow that a number over them passes 2^52 would not tell numbers apart; infinite ends are a width of their own.
    large = F.greatest(F.abs(F.col(low).cast("double")), F.abs(F.col(high).cast("double")))
    narrow = F.coalesce(F.ceil(F.log2(F.nullif(large, F.lit(0.0)))) - 50, F.lit(-1000))
    exponent = F.greatest(F.coalesce(F.ceil(F.log2(F.when(length > 0, length))), narrow), narrow)
    level = F.when(length < float("inf"), exponent.cast("int")).otherwise(F.lit(5000))
    sized = spans.withColumn("_level", level)
    widths = sorted(r["_level"] for r in sized.select("_level").distinct().collect())
    bin_at = lambda c: F.when(F.col("_level") == 5000, F.lit(0.0)).otherwise(F.floor(F.col(c).cast("double") * F.pow(F.lit(2.0), -F.col("_level"))).cast("double"))
    left = known.withColumn("_level", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>"))).withColumn("_bin", bin_at(at))
    first, last = bin_at(low), bin_at(high)
    right = sized.withColumn("_first", first).withColumn("_steps", (last - first).cast("int"))
    right = right.withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("_steps")))).withColumn("_bin", F.col("_first") + F.col("_step")).drop("_first", "_step", "_steps")
    return left.join(right, ["_level", "_bin"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_level", "_bin")


def as_of_join(rows: DataFrame, facts: DataFrame, key: str, time: str, order: str, value: str, name: str, stretch: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with name: value of the last of facts with the same key and a time not after theirs; null if there is none.

    Both have key, time and order, which decides between equal times. Facts whose value is null do not count. One window over
    both takes the place of a join, so pairs are never made.

    stretch: cuts time in stretches that ascend with it, such as days, so that a key with very many rows is many tasks: each
    stretch is a window of its own, and rows before its first fact take the last one of the stretches before, of which there
    is a row for each key and stretch.
    """
    both = rows.withColumn("_fact", F.lit(None).cast(facts.schema[value].dataType)).withColumn("_late", F.lit(1)).unionByName(
        facts.select(key, time, order, F.col(value).alias("_fact"), F.lit(0).alias("_late")), allowMissingColumns=True
    )
    parts = [key] if stretch is None else [key, "_stretch"]
    both = both if stretch is None else both.withColumn("_stretch", stretch(F.col(time)))
    before = Window.partitionBy(*parts).orderBy(time, "_late", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(name, F.last("_fact", ignorenulls=True).over(before)).filter("_late = 1").drop("_fact", "_late")
    if stretch is None:
        return found
    known = facts.filter(F.col(value).isNotNull()).select(F.col(key).alias("_key"), stretch(F.col(time)).alias("_stretch"), F.struct(time, order, F.col(value).alias("fact")).alias("_at"))
    lasts = known.groupBy("_key", "_stretch").agg(F.max("_at").alias("_at")).unionByName(rows.select(F.col(key).alias("_key"), stretch(F.col(time)).alias("_stretch")).distinct(), allowMissingColumns=True)
    lasts = lasts.groupBy("_key", "_stretch").agg(F.max("_at").alias("_at"))
    earlier = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_key", F.col("_stretch").alias("_of"), F.last("_at", ignorenulls=True).over(earlier)["fact"].alias("_carried")).filter("_carried is not null")
    same = (F.col(key) == F.col("_key")) & (F.col("_stretch") == F.col("_of"))
    return found.join(carried, same, "left").withColumn(name, F.coalesce(name, "_carried")).drop("_key", "_of", "_stretch", "_carried")


def places(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """df with the place of each row in the order of the whole table, from 1.

    A sample sort: splitters drawn from a sample cut the order in ranges of about equal size, by all order columns, so that
    rows that agree in the first ones are split by the others. The rows of a range are counted exactly, and what lies before a
    range is added to the places in it; the only window without a key sees a row per range. Rows that agree in every order
    column lie in one range and have an order of their own. Nulls come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.struct("*").alias("_row"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)])
    by = [f"_by{i}" for i in range(len(order))]
    rows = held(ranged.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).select("_row", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(before), "_range")  # a row for each of n ranges
    return placed.select("_row.*", (F.col("_before") + F.col("_place") + 1).alias(name))
