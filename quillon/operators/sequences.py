"""Operations on ordered rows within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_start(value: Column, window) -> Column:
    """True on the first row of a run of equal values."""
    before = F.lag(value).over(window)
    return before.isNull() | (before != value)


def run_end(value: Column, window) -> Column:
    after = F.lead(value).over(window)
    return after.isNull() | (after != value)


def islands(df: DataFrame, keys: list[str], at: Column, gap: Column, order: list[str]) -> DataFrame:
    """df with island: rows of a group belong together while the step to the next one is not larger than gap."""
    window = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(window)) > gap, F.lit(True))
    return df.withColumn("island", F.sum(new.cast("long")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def centred_mean(value: Column, window, width: int = 5) -> Column:
    """Moving mean; what lies beyond the ends counts as zero, so the divisor stays the width. An even width has one row more
    before than after."""
    return F.sum(value).over(window.rowsBetween(-(width // 2), (width - 1) // 2)) / F.lit(width)


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key; combined before the shuffle."""
    last = F.max(F.struct(*dict.fromkeys([*order, *values]))).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{v}") for v in values])
