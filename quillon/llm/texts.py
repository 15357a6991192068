"""Texts as numbered rows of bytes, and what is found about them.

Every row gets a number, rid. The texts are dealt by it once, as a bucketed table; what a search finds about a row is
aggregated by rid and joined to the text where that lies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bucketed

#: Above any place in a text.
_FAR = 1 << 40


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """rid, doc_id and text of every row of docs, written; null text counts as empty."""
    buckets = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100_000)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    return bucketed(rows.select("rid", "doc_id", "text"), "rid", buckets, name)


def flattened(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Owner of each item of an array of lists, and the items; null lists have none."""
    return pc.list_parent_indices(lists).to_numpy().astype(np.int64), pc.list_flatten(lists)


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, begin and end of the maximal spans by owner; spans that touch become one."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order].astype(np.int64), begin[order], end[order]
    reach = np.maximum.accumulate(owner * _FAR + end)
    first = np.flatnonzero(np.r_[True, (owner * _FAR + begin)[1:] > reach[:-1]])
    last = np.r_[first[1:] - 1, len(owner) - 1]
    return owner[first], begin[first], reach[last] - owner[last] * _FAR


def without(raw: bytes, begin: list[int], end: list[int]) -> bytes:
    """The bytes outside of the spans, which ascend."""
    return b"".join(raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)])) if begin else raw


class Cuts:
    """Collects doc_id, n_bytes, some counts, n_removed, n_spans, kept_sha256 and kept of texts in batches of limited size."""

    def __init__(self, id_kind: pa.DataType, counts: list[str], most_bytes: int = 4 << 20):
        self.names = ["doc_id", "n_bytes", *counts, "n_removed", "n_spans", "kept_sha256", "kept"]
        self.kinds = [id_kind, *[pa.int64()] * (len(counts) + 3), pa.string(), pa.binary()]
        self.most, self.rows, self.size = most_bytes, [], 0

    def add(self, doc_id, raw: bytes, counts: tuple, begin: list[int], end: list[int]) -> pa.RecordBatch | None:
        kept = without(raw, begin, end)
        self.rows.append((doc_id, len(raw), *counts, sum(end) - sum(begin), len(begin), hashlib.sha256(kept).hexdigest(), kept))
        self.size += len(kept) + 200
        return self.flush() if self.size > self.most else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = [pa.array(c, k) for c, k in zip(zip(*self.rows), self.kinds)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, self.names)

    def schema(self, id_type: str) -> str:
        return f"doc_id {id_type}, " + ", ".join(f"{n} bigint" for n in self.names[1:-2]) + ", kept_sha256 string, kept binary"
