"""Sinks: pages, JSON catalogues and keyed upserts, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import latest


def write_pages(pages: DataFrame, folder: str, key: str, html: str) -> None:
    """One folder per key with the text of its page in it."""
    pages.select(F.col(key), F.col(html).alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    """JSON lines; characters beyond ASCII stay as they are."""
    rows.write.mode("overwrite").json(folder)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The table after changes: the last write of each key wins, and a last write whose values are all null deletes it."""
    everything = current.select(*keys, *order, *values).unionByName(changes.select(*keys, *order, *values))
    last = latest(everything, keys, order, [*order, *values])
    return last.filter(F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())
