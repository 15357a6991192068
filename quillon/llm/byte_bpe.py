"""Byte-level BPE with two-tier lookup.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole, many at once. A miss is
merged from its bytes: the bytes form a linked list, and a heap yields the pair of lowest rank, leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..functions.shipping import ship
from .memory import given_back, kept
from .pretokens import Memory, cut, ranges, spread
from .words import slices, texts_of

#: No token's id; pairs with nothing.
_NOTHING = 0xFFFFFFFF


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from lines of "base64 rank"; a rank is also the token's id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Scrambles 64-bit values; the constants are those of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt) if np.isscalar(salt) else x ^ salt) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys fill n slots without gaps or collisions.

    A key's first hash names its group. Groups, the largest first, try displacements until their keys all fall into free
    slots; all groups of one size try the same one at once. A group of one key names a slot that is left. What each group
    found is all that is stored, besides the keys for the check of a hit.
    """

    def __init__(self, keys: list[bytes], per_group: int = 4):
        self.n, self.groups = len(keys), max(1, len(keys) // per_group)
        first = self.digest(keys)
        group = (first % np.uint64(self.groups)).astype(np.int64)
        #: A displacement, or a slot as -1 - slot.
        self.displace = np.zeros(self.groups, np.int64)
        slot_of = np.zeros(self.n, np.int64)
        taken, owner = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        order = np.argsort(group, kind="stable")
        size = np.bincount(group, minlength=self.groups)
        begin = np.cumsum(size) - size
        for width in range(int(size.max(initial=0)), 1, -1):
            open_ = np.flatnonzero(size == width)
            displacement = 0
            while len(open_) > 64:
                displacement += 1
                members = order[begin[open_][:, None] + np.arange(width)]
                slots = self._slots(first[members], np.uint64(displacement))
                rows = np.flatnonzero(self._free(slots, taken))
                owner[slots[rows[::-1]]] = rows[::-1, None]  # of groups that want one slot, the first has it
                won = rows[(owner[slots[rows]] == rows[:, None]).all(axis=1)]
                taken[slots[won]] = True
                slot_of[members[won]] = slots[won]
                self.displace[open_[won]] = displacement
                open_ = np.delete(open_, won)
            for g in open_.tolist():  # the last ones, each with many displacements at once
                members, tries = order[begin[g] : begin[g] + width], np.arange(1, 4097, dtype=np.uint64)
                while not (good := self._free(slots := self._slots(first[members][None, :], tries[:, None]), taken)).any():
                    tries += np.uint64(len(tries))
                hit = int(good.argmax())
                taken[slots[hit]] = True
                slot_of[members] = slots[hit]
                self.displace[g] = int(tries[hit])
        single = np.flatnonzero(size == 1)
        left = np.flatnonzero(~taken)
        self.displace[single] = -1 - left
        slot_of[order[begin[single]]] = left
        self.slot_index = np.zeros(self.n, np.int64)
        self.slot_index[slot_of] = np.arange(self.n)
        self.slot_key = [keys[i] for i in self.slot_index.tolist()]

    @staticmethod
    def _free(slots: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Rows of different slots that are free."""
        ordered = np.sort(slots, axis=1)
        return ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)

    def _slots(self, first: np.ndarray, displacement: np.ndarray | np.uint64) -> np.ndarray:
        return (_mix(first, displacement) % np.uint64(self.n)).astype(np.int64)

    @staticmethod
    def digest(keys: list[bytes]) -> np.ndarray:
        """64-bit polynomial hash of each key, all keys at once."""
        if not keys:
            return np.zeros(0, np.uint64)
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        data = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
        end = np.cumsum(lengths)
        place = np.arange(len(data)) - np.repeat(end - lengths, lengths)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(lengths.max()) + 1 if len(lengths) else 1, 0x100000001B3, np.uint64))
            terms = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * powers[place])])
            return _mix(terms[end] - terms[end - lengths], 0x5851F42D4C957F2D)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key among those that built the hash, or -1."""
        if not self.n or not keys:
            return np.full(len(keys), -1, np.int64)
        first = self.digest(keys)
        found = self.displace[(first % np.uint64(self.groups)).astype(np.int64)]
        slots = np.where(found < 0, -1 - found, self._slots(first, found.astype(np.uint64)))
        held = self.slot_key
        same = np.fromiter((held[s] == k for s, k in zip(slots.tolist(), keys)), bool, len(keys))
        return np.where(same, self.slot_index[slots], -1)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.tokens = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.whole = PerfectHash(self.tokens)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs = _pair_ranks(ranks)
        self.byte_pairs = {(a, b): self.pairs.get(self.single[a] << 32 | self.single[b], -1) for a in range(256) for b in range(256)}
        size = int(self.ids.max()) + 1
        self.token_length = np.zeros(size, np.int64)
        self.token_length[self.ids] = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.token_begin = np.zeros(size, np.int64)
        self.token_begin[self.ids] = np.cumsum(self.token_length[self.ids]) - self.token_length[self.ids]
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.memory = Memory(self._learn)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token as a whole.

        A heap entry is rank * 2^32 + place of the left one of a pair; it counts while `current` holds it for that
        place. Place n stands before the first byte and behind the last and pairs with nothing.
        """
        n, single, get = len(word), self.single, self.pairs.get
        ids = [single[b] for b in word]
        current = [-1 if r < 0 else r << 32 | i for i, r in enumerate(map(self.byte_pairs.__getitem__, zip(word, word[1:])))]
        heap = [e for e in current if e >= 0]
        heapify(heap)
        ids.append(_NOTHING)
        current += (-1, -1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        before[0] = n
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            if current[i] != entry:
                continue  # one of the two has been merged meanwhile
            rank, j = entry >> 32, after[i]
            ids[i], ids[j], current[j] = rank, -1, -1
            after[i] = k = after[j]
            before[k], h = i, before[i]
            made = get(rank << 32 | ids[k])
            if made is None:
                current[i] = -1
            else:
                current[i] = e = made << 32 | i
                heappush(heap, e)
            made = get(ids[h] << 32 | rank)
            if made is None:
                current[h] = -1
            else:
                current[h] = e = made << 32 | h
                heappush(heap, e)
        ids.pop()
        return [x for x in ids if x >= 0]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self.pattern.findall, pieces))
        words = list(dict.fromkeys(chain.from_iterable(split)))
        raw = [w.encode() for w in words]
        merge, id_of = self.merge, self.ids
        coded = {w: (merge(r) if f < 0 else [int(id_of[f])]) for w, r, f in zip(words, raw, self.whole.find(raw).tolist())}
        rows = [coded[s[0]] if len(s) == 1 else list(chain.from_iterable(map(coded.__getitem__, s))) for s in split]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return lengths, np.fromiter(chain.from_iterable(rows), np.uint32, int(lengths.sum()))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, start of each text and the end)."""
        pieces = cut(texts)
        return spread(pieces, *self.memory.ids(pieces.unique))

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.large_string()))[0].tolist()

    def decode(self, ids) -> bytes:
        """Bytes of the ids; they need not be whole characters."""
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[ranges(self.token_begin[ids], self.token_length[ids])].tobytes()


def _pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the merge of two adjacent tokens, by (left id << 32 | right id): every way to cut a token in two tokens."""
    pairs = {}
    for token, rank in ranks.items():
        for cut_at in range(1, len(token)):
            left, right = ranks.get(token[:cut_at]), ranks.get(token[cut_at:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return pairs


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each Python process and kept while its tasks encode."""
    return kept(("byte_bpe", path, pattern), lambda: Codec(read_ranks(path), pattern))


def encoded(docs: DataFrame, path: str, pattern: str, most_bytes: int = 2 << 20) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    docs: doc_id, text; other columns are not read. path: a rank file that every executor has, like the library itself.
    Returns doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit), ids_sha256, decoded_sha256.
    Null text counts as empty: no ids, and the digests of nothing. Rows stay rows: repeated ones are encoded alike. An empty
    table gives no rows. Texts are taken in slices of most_bytes, and a longer one by itself.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(lambda batches: given_back(_encode(batches, path, pattern, most_bytes), ("byte_bpe", path, pattern)), schema)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    sha = hashlib.sha256
    for batch in batches:
        texts = texts_of(batch.column(1))
        for a, b in slices(texts, most_bytes):
            ids, starts = own.encode_batch(texts.slice(a, b - a))
            raw, bounds = ids.astype("<u4").tobytes(), starts.tolist()
            ids_of = [raw[4 * s : 4 * e] for s, e in zip(bounds, bounds[1:])]
            back = [sha(own.decode(ids[s:e])).hexdigest() for s, e in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(starts)), pa.array(ids_of, pa.binary()), pa.array([sha(x).hexdigest() for x in ids_of]), pa.array(back)],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )
