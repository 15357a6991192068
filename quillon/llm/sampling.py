"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32 of doc_id written as text, modulo modulus; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int | None = None) -> DataFrame:
    """doc_id, label and text of at most per_class rows of each label.

    Rows are chosen by the smallest hash of doc_id, so the choice follows the table alone; a text's length plays no part.
    With most_bytes, each label's rows end where their texts reach half of that, in the same order. A doc_id that repeats
    in docs gives a row each time. Null text counts as empty; a null doc_id has no label.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null")
    order = F.xxhash64("doc_id")
    some = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    some = some.groupBy("doc_id").agg(F.max("label").alias("label"))  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    if most_bytes is None:
        return rows
    sizes = rows.select("doc_id", "label", order.alias("h"), F.octet_length("text").alias("size")).groupBy("doc_id", "label", "h").agg(F.sum("size").alias("size"))
    left, kept = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for r in sorted(sizes.collect(), key=lambda r: (r["h"], r["doc_id"])):
        if left[r["label"]] > 0:
            kept.append((r["doc_id"],))
        left[r["label"]] -= r["size"]
    if min(left.values()) > 0:
        return rows
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, rows.select("doc_id").schema)), "doc_id").select("doc_id", "label", "text")


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many rows of labels have 0 and 1."""
    row = labels.agg(F.count_if(F.col(label) == 0).alias("no"), F.count_if(F.col(label) == 1).alias("yes")).first()
    return row["no"], row["yes"]
