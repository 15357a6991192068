"""Cuts texts into pieces that byte-level BPE encodes independently, without a Python object for each piece.

The pre-token pattern never matches across a step from a character that is no white space to one that is: every
alternative is either `\\s+`, or optional blank space followed by characters without white space. So a text may be cut
before each run of white space, and equal pieces need to be encoded once. Most texts have single spaces and line ends
only and are cut by Arrow's kernels; the others are cut by a pattern.
"""

from __future__ import annotations

import gc
import secrets
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from xxhash import xxh3_128_digest

#: Any white space but single spaces and line ends, or the mark that shall separate pieces.
_UNUSUAL = r"[ \n][ \n]|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PIECE = regex.compile(r"\s*\S+|\s+")
_MARK = "\x00"
_SEED = secrets.randbits(64)


@dataclass
class Pieces:
    """unique: the different pieces, some of them twice; ids: for each piece its place there; starts: first piece of each
    text, and the end."""

    unique: pa.Array
    ids: np.ndarray
    starts: np.ndarray


def cut(texts: pa.Array) -> Pieces:
    marked = pc.replace_substring(pc.replace_substring(texts, " ", _MARK + " "), "\n", _MARK + "\n")
    lists = pc.split_pattern(marked, _MARK)
    odd = np.flatnonzero(pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False))
    starts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    unique, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    if len(odd):
        place: dict[str, int] = {}
        runs = np.split(ids, starts[1:-1])
        for i in odd.tolist():
            own = _PIECE.findall(texts[i].as_py())
            runs[i] = len(unique) + np.fromiter((place.setdefault(piece, len(place)) for piece in own), np.int64, len(own))
        unique, ids = pa.concat_arrays([unique, pa.array(list(place), unique.type)]), np.concatenate(runs)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    return Pieces(unique, ids, starts)


def spread(pieces: Pieces, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, and where each text starts.

    lengths, flat: how many ids each different piece has, and those ids in the order of the pieces.
    """
    begin = np.cumsum(lengths) - lengths
    n = lengths[pieces.ids]
    return flat[ranges(begin[pieces.ids], n)], np.concatenate([[0], np.cumsum(n)])[pieces.starts]


def ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for lengths[0] places, then the same for every other entry."""
    end = np.cumsum(lengths)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin - (end - lengths), lengths)


def digests(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of an XXH3 digest of 128 bits of each piece's bytes. Digests live in one process only, whose seed is drawn
    at random, so that no text can be made to collide."""
    raw = b"".join([xxh3_128_digest(p, _SEED) for p in pieces.cast(pa.large_binary()).to_pylist()])
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class _Store:
    """Ids of pieces by their digests, about 40 bytes a piece: the first digest in order, the second for the check of a hit,
    and the place of the ids in arrays that grow by doubling."""

    def __init__(self):
        self.first, self.second, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends, self.used, self.rows = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Pieces that are not held yet, each once."""
        n = len(first)
        while self.rows + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.rows + 1 : self.rows + 1 + n] = self.used + np.cumsum(lengths)
        order = np.argsort(first)
        at = np.searchsorted(self.first, first[order])
        self.first, self.second = np.insert(self.first, at, first[order]), np.insert(self.second, at, second[order])
        self.row = np.insert(self.row, at, self.rows + order)
        self.used, self.rows = self.used + len(flat), self.rows + n

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Row of each piece, or -1."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), self.row[at], -1)

    def get(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, flat ids) of those rows."""
        begin = self.ends[rows]
        lengths = self.ends[rows + 1] - begin
        return lengths, self.flat[ranges(begin, lengths)]


class Memory:
    """Ids of pieces seen before in this process, in two generations: when the younger one holds `most` pieces, it takes the
    place of the older one. Pieces found in the older one move to the younger, so common ones stay.

    Pieces are told apart by digests of 128 bits, whatever their length. learn: gives (lengths, flat ids) of pieces that are not held; it is given `step`
    pieces at a time, so that what it makes on the way stays small.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, step: int = 1 << 15):
        self.learn, self.most, self.step = learn, most, step
        self.young, self.old = _Store(), _Store()

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, flat ids) of the pieces in their order."""
        if self.young.rows > self.most:
            self.young, self.old = _Store(), self.young
        first, second = digests(pieces)
        missing = np.flatnonzero(self.young.find(first, second) < 0)
        missing = missing[np.unique(first[missing], return_index=True)[1]]
        before = self.old.find(first[missing], second[missing])
        again = missing[before >= 0]
        if len(again):
            self.young.add(first[again], second[again], *self.old.get(before[before >= 0]))
            missing = missing[before < 0]
        if len(missing):
            self._learn(pieces.take(pa.array(missing)), first[missing], second[missing])
        rows = self.young.find(first, second)
        clash = np.flatnonzero(rows < 0)  # another piece has the same first digest
        if not len(clash):
            return self.young.get(rows)
        lengths, flat = self.learn(pieces.to_pylist())
        return lengths, flat

    def _learn(self, pieces: pa.Array, first: np.ndarray, second: np.ndarray) -> None:
        collecting, parts = gc.isenabled(), []
        gc.disable()  # millions of small lists without cycles; looking for cycles among them costs a third of the time
        try:
            for a in range(0, len(pieces), self.step):
                parts.append(self.learn(pieces.slice(a, self.step).to_pylist()))
        finally:
            if collecting:
                gc.enable()
        self.young.add(first, second, *(np.concatenate(x) for x in zip(*parts)))
