"""Memory of Python workers."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quillon.llm import byte_bpe, memory, quality, words


def test_sums_of_named_rows():
    rng = np.random.default_rng(1)
    table, ids, starts = rng.random((7, 3)).astype(np.float32), rng.integers(0, 7, 40), np.array([0, 0, 11, 11, 40])
    got = words.sums_of(table, ids, starts)
    assert np.allclose(got, [table[ids[a:b]].sum(axis=0, dtype=float) for a, b in zip(starts, starts[1:])], atol=1e-12)
    assert np.array_equal(words.sums(table[ids], starts), got)


def test_features_take_little_memory():
    """Of 8 MB of texts; numpy's arrays count."""
    rng = random.Random(2)
    texts = pa.array([" ".join(rng.choice(("a", "of", "Der", "wort,", "x9")) + str(i % 7) for i in range(400)) for _ in range(4000)], pa.large_string())
    tracemalloc.start()
    try:
        x = quality.features(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert x.shape == (4000, len(quality.FEATURES)) and peak < 48 << 20


def test_workers_keep_nothing_for_other_stages():
    one = memory.kept("one", lambda: [1])
    assert list(memory.given_back([memory.kept("one", list)], "one")) == [[1]] and memory.kept("one", list) is one
    assert list(memory.given_back([])) == [] and memory.kept("one", list) is not one
    assert byte_bpe.kept is memory.kept
