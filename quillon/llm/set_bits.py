"""What the joins over shingle sets share: digests and parities of sets, and runs of sorted rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
BITS = 512


def digest_of(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(members: np.ndarray, bits: int = BITS) -> bytes:
    return np.packbits((np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def most_apart(total, s: Fraction):
    """In how many shingles two similar sets of that many in all may differ."""
    return total + 2 * (-s.numerator * total // (s.numerator + s.denominator))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, and the bounds of the runs, from rows sorted by their first column."""
    held: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column(0).to_numpy()
        return rows, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield table()
            held = []
        if len(new):
            held.append(batch.slice(0, int(new[-1])))
            yield table()
            held = [batch.slice(int(new[-1]))]
        else:
            held.append(batch)
    if held:
        yield table()
