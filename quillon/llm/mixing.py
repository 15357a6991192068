"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies, in proportion to its weight. Its whole part is certain; the rest is an
inclusion probability p, and the documents that get one copy more are those with the smallest ranks

    (u / (1 - u)) / (p / (1 - p)),    u uniform in (0, 1), drawn from the seed and the document's identifier,

until the sample has the size that the source still needs. The size of a sample is counted in words, so a source is
filled to its target even where lengths differ a thousandfold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
CYCLE = (3.0, 1.0, 2.0)
#: Weights of documents count in so many steps for each doubling.
STEPS = 8
#: Slices of ranks that are gone through one by one where a source's sample ends.
LAST = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source: source, source_size, n_docs, target.

    sizes: source, source_size, n_docs, one row per source. The sources, by code point and null last, weigh `weights`
    in turn and share `share` times all words; no target passes `most` times its source's own size, and what is cut
    off is dealt again by weight until none passes. That end is reached at once: with the sources ordered by
    cap / weight, some first ones stop at their caps and all later ones get one rate per weight.
    The windows see one row per source, never documents.
    """
    every = Window.partitionBy()
    place = F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    t = t.withColumn("all_words", F.lit(float(share)) * F.sum("source_size").over(every))
    t = t.withColumn("capped", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rate = (F.col("all_words") - F.coalesce("capped", F.lit(0.0))) / F.col("open_weight")
    t = t.withColumn("rate", F.when(rate * F.col("weight") <= F.col("cap"), rate))
    t = t.withColumn("rate", F.first("rate", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def _unit(seed: int, *of: Column) -> Column:
    """A number in (0, 1) drawn from a hash: the same at every run and on every executor."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def by_length(size: Column) -> Column:
    """A document's weight within its source: its length's logarithm, so that longer ones are likelier but do not push out short ones."""
    return F.log2(size + 1.0)


def _expected(docs: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Expected copies by document: in proportion to its weight, at most `most`, and meeting the source's target in words.

    With the weights of a source in descending order, some first ones stop at `most` and all later ones get one rate. The
    windows see a row for each step of weight and source, never documents.
    """
    named = targets.select(F.col("source").alias("_s"), "source_size", "n_docs", "target")
    t = docs.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    step = F.pow(F.lit(2.0), F.round(F.log2("weight") * STEPS) / STEPS)
    t = t.withColumn("weight", F.when((F.col("size") > 0) & (F.col("weight") > 0), step).otherwise(0.0))
    steps = t.filter("weight > 0").groupBy("source", "weight").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    down = Window.partitionBy("source").orderBy(F.desc("weight"))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    open_ = F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = steps.withColumn("rate", F.greatest(F.col("target") - full, F.lit(0.0)) / open_).filter(F.col("rate") * F.col("weight") <= most)
    rates = written(rates.groupBy(F.col("source").alias("_s")).agg(F.max_by("rate", "weight").alias("_rate")), "rates")
    t = t.join(rates, F.col("source").eqNullSafe(F.col("_s")), "left")
    expected = F.when(F.col("weight") > 0, F.least(F.lit(most), F.coalesce(F.col("_rate") * F.col("weight"), F.lit(most)))).otherwise(0.0)
    return t.withColumn("expected", expected).drop("_s", "_rate")


def mix(docs: DataFrame, weights: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """How many copies of each document the mix takes.

    docs: doc_id, source, size (words) and weight; without that, by_length of the size.
    Returns doc_id, source, size, source_size, target, copies; one row for each row of docs.

    Documents of size 0, or of no weight above 0, get no copies; a source of size 0 has target 0; a null source is a source
    like any other; rows that repeat doc_id and size rank alike, and doc_id, then size decide ties. A document longer than its
    source's target leaves is passed over for the next ones that fit. Other columns are not read, whatever their names. An
    empty table gives no rows.

    The sample of a source ends within one of about sqrt(n) slices of its ranks (n: its documents). Slices before that
    one are taken whole; only the documents of that and the next few slices are gone through one by one, so no task holds
    more than a few times sqrt(n) rows of a source, and no source is sorted.
    """
    ship(docs.sparkSession)
    weight = F.col("weight").cast("double") if "weight" in docs.columns else by_length(F.col("size"))
    docs = docs.select("doc_id", "source", "size", weight.alias("weight"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = written(source_targets(sizes, weights, share, most), "source-targets")
    t = _expected(docs, targets, most)
    t = t.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.floor("expected"))
    odds = F.col("p") / (1 - F.col("p"))
    u = _unit(seed, F.col("doc_id"), F.col("size"))
    t = t.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (1 - u)) / odds))
    # One rank in (0, 1) per source, even where the probabilities are equal; it only serves to cut slices.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    typical = F.greatest(F.least(ratio - F.floor(ratio), F.lit(0.999)), F.lit(0.001))
    scaled = F.col("rank") * (typical / (1 - typical))
    slices = F.ceil(F.sqrt("n_docs"))
    t = t.withColumn("slice", F.when(F.col("rank").isNotNull(), F.least(F.floor(scaled / (1 + scaled) * slices), slices - 1)).cast("long"))
    t = t.drop("p", "expected", "weight")

    certain = t.groupBy("source").agg(F.first("target").alias("_target"), F.sum(F.col("whole") * F.col("size")).alias("_certain"))
    slice_words = t.filter("slice is not null").groupBy("source", "slice").agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("slice"))
    ends = slice_words.withColumn("_upto", upto).alias("w").join(certain.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")))
    need = F.col("_target") - F.col("_certain")
    last = ends.filter(F.col("_upto") > need).groupBy("w.source").agg(
        F.min("slice").alias("last_slice"), F.min_by(need - (F.col("_upto") - F.col("_words")), "slice").alias("left")
    ).withColumnRenamed("source", "_s")
    t = t.join(written(last, "last-slices"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    extra = F.when(F.col("slice").isNotNull() & (F.col("last_slice").isNull() | (F.col("slice") < F.col("last_slice"))), 1).otherwise(0)
    out = ["doc_id", "source", "size", "source_size", "target", "copies"]
    at_end = F.coalesce(F.col("slice").between(F.col("last_slice"), F.col("last_slice") + LAST - 1), F.lit(False))
    plain = t.filter(~at_end).withColumn("copies", (F.col("whole") + extra).cast("long")).select(*out)
    ranked = t.filter(at_end).select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.unionByName(ranked.groupBy("source").applyInPandas(_fill, schema))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The last slices of a source: in rank order, whoever still fits; at the end one more if that comes closer."""
    rows = rows.sort_values(["rank", "doc_id", "size"], kind="stable")
    left, taken, sizes = float(rows["left"].iloc[0]), [], rows["size"].tolist()
    for size in sizes:
        taken.append(size <= left)
        left -= size if taken[-1] else 0
    over = [(size - left, i) for i, size in enumerate(sizes) if not taken[i]]
    if over and min(over)[0] < left:
        taken[min(over)[1]] = True
    rows["copies"] = rows["whole"].astype("int64") + pd.Series(taken, index=rows.index).astype("int64")
    return rows[["doc_id", "source", "size", "source_size", "target", "copies"]]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text, however long; null: 0) of every document, written once so that the
    texts are read once. Other columns are not read, whatever their names."""
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it, all columns kept.

    Copies are joined back by doc_id and size; of rows that repeat both, and so rank alike, each is taken alike. Columns
    travel as one struct, so no name of theirs can clash with a name used here.
    """
    plan = mix(sized(docs), **options).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("words", word_count(F.col("row.text")))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    return rows.join(plan, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
