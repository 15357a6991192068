"""Exact top-k search by inner product, as a Voronoi join.

Pivots cut the space into cells; every vector and every query belongs to the cell of its nearest pivot. A query is solved
in its own cell first, which gives it a real k-th best score. Summaries of the cells then bound what it can find in any
other: with r the pivot, no vector of a cell scores more than q.r + |q| times the cell's radius, nor more than |q| times
its largest norm. The query goes only to the cells whose bound reaches its k-th score. Cells and the queries that come to
them are cut in blocks of limited size, so neither a crowded cell nor a common vector makes a large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .store import written

#: Pivots grow with the root of the number of vectors, within these bounds: the driver holds one row for each.
PIVOTS = (16, 1024)


def quantised(vectors: DataFrame, scale: int = 256, column: str = "embedding") -> DataFrame:
    """vec_id and v, each component x as floor(scale * x); vectors that are null or hold null or no number are left out."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("bigint"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select("vec_id", v.alias("v"))


def _matrix(arrays, dim: int) -> np.ndarray:
    """Rows of int64; a shorter vector ends in zeros."""
    rows = [np.asarray(a, np.int64) for a in arrays]
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they stop at the ends of the range."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance, in doubles; distances are rounded up a little, as they serve as bounds."""
    v, p = v.astype(float), pivots.astype(float)
    square = (v * v).sum(axis=1)[:, None] - 2 * v @ p.T + (p * p).sum(axis=1)[None, :]
    cell = square.argmin(axis=1)
    away = np.sqrt(((v - p[cell]) ** 2).sum(axis=1))
    return cell, away * (1 + 1e-9) + 1e-6


def _with_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v (all of one length), cell, away (from its pivot) and norm."""
    dim = pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1).to_pylist(), dim)
            cell, away = _nearest(v, pivots)
            norm = np.sqrt((v.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
            columns = [batch.column(0), _lists(v), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cell", "away", "norm"])

    return vectors.mapInArrow(assign, "vec_id bigint, v array<bigint>, cell int, away double, norm double")


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(len(column), dim)


def _solved(data: DataFrame, asks: DataFrame, sizes: dict[int, int], k: int, dim: int, block: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query (query_id, q) in each block of the cells that it asks."""
    spark = data.sparkSession
    layout = [(r["cell"], -(-sizes[r["cell"]] // block), -(-r["count"] // block)) for r in asks.groupBy("cell").count().collect() if sizes.get(r["cell"])]  # a row per pivot at most
    layout = spark.createDataFrame(layout, "cell int, n_parts int, n_chunks int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part, chunk = F.pmod(F.xxhash64("vec_id", "v"), F.col("n_parts")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("n_chunks")).cast("int")
    data_rows = data.join(layout, "cell").select("cell", part.alias("part"), every("n_chunks").alias("chunk"), "vec_id", "v")
    query_rows = asks.join(layout, "cell").select("cell", every("n_parts").alias("part"), chunk.alias("chunk"), "query_id", "q")
    unit, names = ["cell", "part", "chunk"], ["query_id", "vec_id", "score"]

    def solve(x: pa.Table, q: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], pa.int64())] * 3, names)]
        if x.num_rows and q.num_rows:
            x = x.sort_by("vec_id")
            ids, own = x["vec_id"].to_numpy(), q["query_id"].to_numpy()
            a, b = _rows(q["q"], dim), _rows(x["v"], dim)
            for at in range(0, len(own), 256):
                row, col, score = _best(_products(a[at : at + 256], b), own[at : at + 256], ids, k)
                out.append(pa.table([pa.array(own[at + row]), pa.array(ids[col]), pa.array(score)], names))
        return pa.concat_tables(out)

    return data_rows.groupBy(*unit).cogroup(query_rows.groupBy(*unit)).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")


def _best(score: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k largest scores of each row, ties to the earlier column; ids equal to own are none."""
    other = ids[None, :] != own[:, None]
    value = np.where(other, score, np.iinfo(np.int64).min)
    least = np.partition(value, max(0, value.shape[1] - k), axis=1)[:, max(0, value.shape[1] - k)]
    row, col = np.nonzero((value >= least[:, None]) & other)
    found = score[row, col]
    order = np.lexsort((col, -found.astype(object) if len(found) and found.min() == np.iinfo(np.int64).min else -found, row))
    row, col, found = row[order], col[order], found[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[keep], col[keep], found[keep]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int | None = None, block: int = 4096) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """What top_k ranks, and what it cost: query_id, vec_id, score of the best found in each block; cell and query_id of
    every cell that a query had to look into; the size of each cell."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = written(vectors.select("vec_id", "v"), "vectors")
    facts = vectors.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim = max(facts["dim"] or 0, 1)
    n_pivots = n_pivots or min(PIVOTS[1], max(PIVOTS[0], int(facts["n"] ** 0.5 / 4)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = np.unique(_matrix([r["v"] for r in sample], dim), axis=0) if sample else np.zeros((1, dim), np.int64)
    data = written(_with_cells(vectors, pivots), "cells")
    asked = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(_with_cells(asked, pivots).select("cell", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "norm"), "query-cells")
    cells = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()  # a row per pivot
    sizes = {r["cell"]: r["n"] for r in cells}
    own = written(_solved(data, queries, sizes, k, dim, block), "found-in-own-cell")
    kth = _ranked(own, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "kth")
    place = np.array([r["cell"] for r in cells], np.int64)
    centre, radius, largest = pivots[place].astype(float), np.array([r["radius"] for r in cells]), np.array([r["norm"] for r in cells])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                norm = part.column(3).to_numpy()[:, None]
                bound = np.minimum(_rows(part.column(2), dim).astype(float) @ centre.T + norm * radius, norm * largest)
                least = part.column(4).to_numpy(zero_copy_only=False)[:, None]  # no number where fewer than k are known
                far = bound + 1e-9 * np.abs(bound) + 1e-6 < least - 1e-9 * np.abs(least)
                row, col = np.nonzero(~far & (place[None, :] != part.column(0).to_numpy()[:, None]))
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(place[col].astype(np.int32)), part.column(1).take(where), part.column(2).take(where)], ["cell", "query_id", "q"])

    known = queries.join(kth, "query_id", "left").select("cell", "query_id", "q", "norm", F.col("kth").cast("double").alias("kth"))
    asks = written(known.mapInArrow(others, "cell int, query_id bigint, q array<bigint>"), "cells-to-search")
    found = own.unionByName(_solved(data, asks, sizes, k, dim, block))
    return found, queries.select("cell", "query_id").unionByName(asks.select("cell", "query_id")), sizes


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int | None = None, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to the smaller vec_id.

    vectors: vec_id, v (array<bigint>). Rows of the query's own vec_id are no candidates. A vec_id that asks twice asks
    once, with its smaller vector; a candidate that repeats takes a rank for each row. Shorter vectors end in zeros.
    Fewer than k candidates give them all; no query or an empty table gives no rows. Scores that do not fit in 64 bits
    stop at the ends of the range and count as ties there.

    Pivots are a sample, the n_pivots smallest hashes of vec_id; results do not depend on them. All vectors are searched:
    the pivots only cut what the bounds rule out.
    """
    found, _, _ = search(vectors, is_query, k, n_pivots, block)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
