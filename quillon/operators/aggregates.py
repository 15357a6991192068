"""Aggregates of one's own with a state, a merge and an end, over Arrow.

Each task makes a state for each group that it has rows of, and states are merged in two rounds, first by parts of the tasks:
no round holds more of a group than a state for each task of a part. Merging in any order and any grouping must give the
same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Parts of the tasks whose states are merged first.
FAN = 32


class Sample:
    """The k rows of a group with the smallest digests: an even sample without replacement, the same however rows are dealt.

    Merging keeps the k smallest of both, which is associative and commutative. Of n rows, a quantile read off the sample is
    off by about 1 / (2 * sqrt(k)) of rank at most, one standard deviation; up to k rows it is exact.
    """

    def __init__(self, k: int = 1024):
        self.k = k

    def kept(self, digests: pa.Array) -> pa.Array:
        """Places of the rows that stay, by digest."""
        order = pc.sort_indices(digests)
        return order.slice(0, self.k)

    @staticmethod
    def quantiles(values: np.ndarray, ranks: list[float]) -> list[float]:
        """The smallest values that at least each share of the values does not exceed."""
        ordered = np.sort(values)
        return [float(ordered[max(0, int(np.ceil(r * len(ordered))) - 1)]) for r in ranks]


def sampled_quantiles(df: DataFrame, group: str, digest: Column, value: str, ranks: list[float], k: int = 1024) -> DataFrame:
    """group, n (rows), sampled (rows of the sample) and quantiles (at ranks) of the values in each group, from a sample.

    digest: a text that tells rows apart, equal for equal rows; of rows with one digest any may stay. Null values are left
    out, and a group without others gives no row; a null group is a group. An empty table gives no rows.
    """
    ship(df.sparkSession)
    sample = Sample(k)
    kind = df.schema[group].dataType.simpleString()
    state = f"part int, g {kind}, n bigint, digest string, value double"
    rows = df.select(F.col(group).alias("g"), digest.alias("digest"), F.col(value).cast("double").alias("value")).filter("value is not null")

    def held(table: pa.Table, part: int, counts: dict | None) -> Iterator[pa.RecordBatch]:
        """The sample of each group in table; n, the rows behind it, stands in its first row."""
        codes = pc.dictionary_encode(table["g"], null_encoding="encode").combine_chunks()
        for code, name in enumerate(codes.dictionary.to_pylist()):
            own = table.filter(pc.equal(codes.indices, code))
            best = own.take(sample.kept(own["digest"]))
            total = own.num_rows if counts is None else counts[name]
            n = pa.array([total] + [0] * (best.num_rows - 1), pa.int64())
            yield from pa.table([pa.array([part] * best.num_rows, pa.int32()), best["g"], n, best["digest"], best["value"]], ["part", "g", "n", "digest", "value"]).combine_chunks().to_batches()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tables, counts, size = TaskContext.get().partitionId() % FAN, [], {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
            tables.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > 1 << 18:  # what can no longer be among the smallest goes
                tables = [pa.Table.from_batches(list(held(pa.concat_tables(tables), part, counts))).select(["g", "digest", "value"])]
                size = tables[0].num_rows
        if tables:
            yield from held(pa.concat_tables(tables), part, counts)

    def merge(table: pa.Table) -> pa.Table:
        name, part = table["g"][0].as_py(), table["part"][0].as_py()
        return pa.Table.from_batches(list(held(table.select(["g", "digest", "value"]), part, {name: pc.sum(table["n"]).as_py()})))

    def end(table: pa.Table) -> pa.Table:
        best = merge(table)
        values = best["value"].to_numpy()
        cuts = pa.array([Sample.quantiles(values, ranks)], pa.list_(pa.float64()))
        return pa.table([best["g"].slice(0, 1), pa.array([pc.sum(best["n"]).as_py()], pa.int64()), pa.array([best.num_rows], pa.int64()), cuts], ["g", "n", "sampled", "quantiles"])

    states = rows.mapInArrow(partial, state)
    fewer = states.groupBy("part", "g").applyInArrow(merge, state)
    found = fewer.groupBy("g").applyInArrow(end, f"g {kind}, n bigint, sampled bigint, quantiles array<double>")
    return found.withColumnRenamed("g", group)
