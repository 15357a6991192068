"""Whitening against a covariance in plain numpy, and vectors that are odd."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon.llm import queries, whitening

from ..conftest import DATA


def whole(vectors):
    """Rows (key, x) that count."""
    width = max((len(v) for _, v in vectors if v is not None), default=0)
    good = [(k, v) for k, v in vectors if v is not None and width and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    return [(k, [math.floor(1024 * float(c)) + 100_000 for c in v]) for k, v in good]


def check(got, vectors):
    rows = whole(vectors)
    n, d = len(rows), len(rows[0][1])
    sums = [sum(x[j] for _, x in rows) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for _, x in rows])
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    k = min(8, d)
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.component) for r in got) == sorted((key is not None, key or 0, c) for key, _ in rows for c in range(1, k + 1))
    deviations = {}
    for key, x in rows:
        deviations.setdefault(key, []).append(sum((n * x[j] - sums[j]) ** 2 for j in range(d)))
    assert all(sorted(r.deviation for r in rs) == sorted(deviations[key]) for key, cs in by_key.items() for rs in cs.values())
    expected = centred @ components[:, :k] / np.sqrt(values[:k])
    single = [(i, key) for i, (key, _) in enumerate(rows) if len(by_key[key][1]) == 1]
    for c in range(k):
        mine = np.array([by_key[key][c + 1][0].whitened for _, key in single])
        plain = expected[[i for i, _ in single], c]
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-6


def run(spark, tmp_path, vectors, parts=3):
    for i in range(parts):
        rows = vectors[i::parts]
        (tmp_path / "embeddings.parquet").mkdir(exist_ok=True)
        table = pa.table({"vec_id": pa.array([k for k, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())), "component": ["x"] * len(rows), "n": [0] * len(rows)})
        pq.write_table(table, tmp_path / f"embeddings.parquet/{i}.parquet")
    return queries.QUERIES["op12_whitening"](spark, str(tmp_path)).collect()


def test_as_registered(spark):
    table = pq.read_table(f"{DATA}/sf0.001/embeddings.parquet")
    got = queries.QUERIES["op12_whitening"](spark, f"{DATA}/sf0.001")
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(got.collect(), list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist())))


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(12, 12)) * np.linspace(3, 0.2, 12)
    vectors = [(i, [float(np.float32(c)) for c in rng.normal(size=12) @ mixing]) for i in range(400)]
    for i, bad in ((3, None), (7, []), (11, [1.0] * 11), (19, [math.nan] * 12), (23, [1.0, None] * 6), (29, [math.inf] + [0.0] * 11)):
        vectors[i] = (i, bad)
    vectors += [(None, vectors[0][1]), (5, vectors[1][1]), (5, vectors[1][1])]  # a null key, and one that repeats
    check(run(spark, tmp_path, vectors), vectors)


def test_few_dimensions_and_heavy_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors = [(i, [1.0, -2.0, 0.5]) for i in range(300)] + [(1000 + i, [float(np.float32(c)) for c in rng.normal(size=3)]) for i in range(50)]
    check(run(spark, tmp_path, vectors), vectors)


def test_no_variance(spark, tmp_path):
    got = run(spark, tmp_path, [(i, [0.25] * 4) for i in range(10)])
    assert len(got) == 40 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in got)


def test_fewer_rows_than_dimensions(spark, tmp_path):
    got = run(spark, tmp_path, [(i, [float(i == j) for j in range(9)]) for i in range(3)])
    assert len(got) == 24 and all((r.whitened is None) == (r.component > 2) for r in got)
    assert got[0].identity_error < 1e-9


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [])], [(1, [math.nan])]])
def test_nothing_counts(spark, tmp_path, vectors):
    assert run(spark, tmp_path, vectors) == []


def test_exact_beyond_64_bits(spark):
    vectors = spark.createDataFrame([(i, [float(x), 1.0]) for i, x in enumerate((0, 1 << 48, 3, 1 << 47))], "vec_id bigint, embedding array<double>")
    fit = whitening.fitted(vectors)
    xs = [0, 1 << 48, 3, 1 << 47]
    expected = [(4 * x - sum(xs)) ** 2 for x in xs]
    assert [int(r.deviation) for r in whitening.whitened(vectors, fit).filter("component = 1").orderBy("vec_id").collect()] == expected


def test_matrices_combine_in_any_order():
    rng = np.random.default_rng(7)
    w = rng.normal(size=(90, 3)) + 1e6
    parts = [np.concatenate([[len(x)], x.mean(axis=0), ((x - x.mean(axis=0)).T @ (x - x.mean(axis=0))).ravel()]) for x in np.split(w, [1, 40, 41])]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        held = parts[order[0]]
        for i in order[1:]:
            held = whitening._combined(held, parts[i], 3)
        assert held[0] == 90 and np.allclose(held[4:].reshape(3, 3) / 90, np.cov(w.T, bias=True), rtol=1e-8)
