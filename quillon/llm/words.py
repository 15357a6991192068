"""Words of many texts as arrays, without a Python object for each word.

Texts come in Arrow batches. They are split by Arrow's own kernels, and each batch's words are encoded as indices
into the batch's different words, so that Python looks at every different word once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """unique: the different words; ids: for each word its place there; starts: first word of each text, and the end."""

    unique: pa.Array
    ids: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Large strings without nulls: null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), pa.scalar("", pa.large_string()))


def slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about most_bytes each; a longer text is a run of its own."""
    total = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(total, total[first] + most_bytes, side="right")) - 1)
        yield first, end
        first = end


def split_words(texts: pa.Array) -> Words:
    """Words are runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    unique, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    drop = pc.index(unique, pa.scalar("", unique.type)).as_py()
    if drop >= 0:  # white space at either end of a text leaves an empty piece
        real = ids != drop
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        ids = ids[real]
    return Words(unique, ids, starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values by text; 0 for a text without words."""
    return sums_of(values, np.arange(len(values)), starts)


def sums_of(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the rows of table that ids name, by text: what sums gives of table[ids], which is not made as a whole."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    columns = table.reshape(len(table), -1).T
    found = np.column_stack([np.bincount(owner, c[ids], n) for c in columns]) if len(columns) else np.zeros((n, 0))
    return found.reshape(n, *table.shape[1:])
