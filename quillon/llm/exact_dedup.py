"""Exact deduplication with skew-safe combining.

Equal texts are found in three steps, and the whole text is a grouping key of each, so a digest alone never
decides that two texts are equal:

1. every task combines its own equal texts (the map-side half of the first aggregation);
2. what is left meets by (digest, salt, text), where the salt is drawn from the task, so that the copies of one
   text spread over `salts` reducers however many tasks hold it;
3. the winners of the salts meet by (digest, text).

Membership is then joined back by digest alone. That is exact because step 3 counted the different texts of every
digest; digests that stand for several texts are treated apart, by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; null counts as empty.

    lower() takes the whole of Unicode, so it serves only where every character is one byte wide.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def text_groups(docs: DataFrame, digest=sha256_hex, salts: int = 16) -> DataFrame:
    """One row per different normalised text: digest, text, keep_id (the largest doc_id), group_size."""
    local = docs.select("doc_id", normalised(F.col("text")).alias("text")).select(
        "doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    )
    salted = local.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def winners(docs: DataFrame, digest=sha256_hex, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(digest, keep_id, group_size) of the digests that stand for one text, and (digest) of all others.

    Both are written tables without texts; the second is empty for any digest worth its name.
    """
    groups = written(text_groups(docs, digest, salts).drop("text"), "text-groups")
    several = groups.groupBy("digest").count().filter("count > 1").select("digest")
    if several.isEmpty():
        return groups, several
    several = written(several, "shared-digests")
    return groups.join(several, "digest", "left_anti"), several


def exact_groups(docs: DataFrame, digest=sha256_hex, salts: int = 16) -> DataFrame:
    """Every row's group of equal texts.

    docs: doc_id, text and any other columns, which are not read.
    Returns doc_id, keep_id, group_size, kept, digest; one row for each row of docs, dropped ones included.

    Null text counts as empty, so null and empty rows are one group. A null doc_id is smaller than any other; a group
    of nulls alone keeps one of them under keep_id null. Of rows that repeat the doc_id and the text of the winner,
    exactly one is kept. An empty table gives no rows.
    """
    groups, several = winners(docs, digest, salts)
    parts = [_members(docs, groups, ["digest"], digest)]
    if not several.isEmpty():
        apart = written(
            docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text"))).join(several, "digest", "left_semi"),
            "texts-of-shared-digests",
        )
        parts.append(_members(apart, text_groups(apart, digest, salts), ["digest", "text"], digest))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _members(docs: DataFrame, groups: DataFrame, keys: list[str], digest) -> DataFrame:
    """Rows of docs with what groups says of them. Rows that repeat doc_id and text travel as one with a count."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(groups, keys)
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", best.alias("best"), "digest", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(
        "doc_id", "keep_id", "group_size", (F.col("best") & (F.col("i") == 1)).alias("kept"), "digest"
    )


def deduplicated(docs: DataFrame, digest=sha256_hex, salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, one row with the largest doc_id.

    Null text counts as empty. Where the winning doc_id repeats, the row of the smallest key stays. An empty table gives
    no rows. Columns travel as one struct, so no name of theirs can clash with a name used here. A winner meets only rows
    of its doc_id and digest, so the copies of one text are never in one task.
    """
    groups, several = winners(docs, digest, salts)
    rows = docs.select(F.struct("*").alias("row"), digest(normalised(F.col("text"))).alias("key"))
    kept = matching_rows(rows, groups.select(F.col("keep_id").alias("doc_id"), F.col("digest").alias("key")), row_key(docs, "row"))
    if not several.isEmpty():
        apart = rows.join(several.withColumnRenamed("digest", "key"), "key", "left_semi").withColumn("text", normalised(F.col("row.text")))
        best = text_groups(apart.select("row.doc_id", "text"), digest, salts).select(F.col("keep_id").alias("doc_id"), F.col("text").alias("key"))
        kept = kept.unionByName(matching_rows(apart.select("row", F.col("text").alias("key")), best, row_key(docs, "row")))
    return kept.select("row.*")


def matching_rows(rows: DataFrame, best: DataFrame, order: Column | None = None) -> DataFrame:
    """Of rows (row: struct with doc_id, key) those named by best (doc_id, key, each pair once): one for each pair.

    Rows that agree in doc_id and key are rivals; the smallest order stays. Only where there are any, those few pairs are
    combined once more, in part before the shuffle.
    """
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("best_key"))
    held = rows.join(best.withColumnRenamed("key", "best_key"), same).select("row", "key")
    ids = rows.select("row.doc_id")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return held.select("row")
    pairs = held.select("row.doc_id", "key").groupBy("doc_id", "key").count().filter("count > 1")
    rivals = written(pairs.select("doc_id", F.col("key").alias("rival_key")), "rival-rows")
    rival = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("rival_key"))
    single = held.join(rivals, rival, "left_anti").select("row")
    order = F.lit(0) if order is None else order
    least = held.join(rivals, rival, "left_semi").groupBy("row.doc_id", "key").agg(F.min_by("row", order).alias("row"))
    return single.unionByName(least.select("row"))


def row_key(df: DataFrame, row: str | None = None) -> Column:
    """A hash over all columns of df, or of its struct column `row`; maps, which have no order, count by their text."""
    column = (lambda name: F.col(row)[name]) if row else (lambda name: F.col(f"`{name}`"))
    return F.xxhash64(*[column(f.name).cast("string") if "map<" in f.dataType.simpleString() else column(f.name) for f in df.schema.fields])
