"""Set similarity join over word shingles, with combinations of shingles as keys.

All pairs of sets with a Jaccard similarity of s or more are linked; the result is what they connect.

1. Shingles are counted, and those that many sets have are put in classes by how many: a rare one is a key by itself, one of
   a frequent class only together with k - 1 others of its class, as k frequent ones meet in few sets.
2. All sets have one order of shingles: rare ones first, then class by class. A set that misses at most e of its shingles in
   a partner needs keys that no e of them destroy. A rare shingle takes one key away, so each counts one; of p shingles of a
   class of k, p - k + 1 must go before no combination is left. A prefix is extended until these counts reach e + 1. Of two
   similar sets, the prefix that ends first then has a key inside the intersection, and the other prefix reaches further, so
   it has that key too.
3. Classes are cut in so many parts, by hash, that about `SHARE` shingles of a prefix fall in each: combinations are made in
   a part only, so their number grows with the prefix and not with its square. The number of parts follows the size of the
   sets in steps of two; a set close below a step has the keys of both sides.
4. In a key, sets are paired with one set of about their size first. What these links leave apart in a key of several
   components is compared in blocks, each pair of blocks in a task of its own, but for blocks of one component: sets that sizes
   and parities leave open go to one home for all keys that lead there and are verified in that place, so that no more is given
   out than links that connect them.
5. Pairs are dropped if sizes or parity bits tell them apart, and verified on the sets otherwise.

Keys and parities come from 64-bit hashes of the shingles; the sets that are verified hold the upper 8 * `BYTES` bits of
each, so that a wrong match of two shingles has a chance of 2^-40 for each pair of different ones. Sets are equal if their
64-bit digests are: among a billion different sets, two share one with a chance of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import simhash
from .components import components
from .memory import given_back
from .set_bits import BITS, SHINGLE, SIMILARITY, _whole_runs, digest_of, most_apart, parities
from .store import written
from .words import texts_of

#: Upper bytes of a shingle's hash that a set holds.
BYTES = 5
#: Classes: from how many sets on, and how many shingles make a key.
CLASSES = ((64, 2), (1_024, 3))
#: Frequent shingles that are told to all tasks, the most frequent ones; all others count as rare.
FREQUENT = 1 << 17
#: Shingles of a prefix in each part of a class, about.
SHARE = 4
#: Keys of up to this many sets pair all; sets of a larger key that are compared in one task, squared.
SHORT, BLOCK = 8, 512
#: Sets of a family that meet in one task, about.
GROUP = 256
#: Bits of the bitmap of names that rows are held against before they are moved.
BITMAP = 1 << 26

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values as the splitmix64 generator does."""
    with np.errstate(over="ignore"):
        x = x + _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def packed(tokens: np.ndarray) -> bytes:
    """Steps between ascending tokens of BYTES bytes, by byte, the lowest first: the highest are zeros mostly."""
    steps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :BYTES].T.tobytes()


def unpacked(raw) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(BYTES, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, :BYTES] = planes.T
    return np.cumsum(whole.view("<u8").ravel(), dtype=np.uint64)


class Keys:
    """Keys of sets. tokens, kinds: the frequent tokens, ascending, and the place of each one's class among classes."""

    def __init__(self, tokens: np.ndarray, kinds: np.ndarray, s: Fraction, classes=CLASSES):
        self.tokens, self.kinds, self.s = tokens, kinds, s
        self.sizes = [k for _, k in classes]
        self.parts: dict[int, list[int] | None] = {}

    def missing(self, n: int) -> int:
        """How many tokens a set of n may have that a similar one has not."""
        return n - -(-self.s.numerator * n // self.s.denominator)

    def level(self, n: int) -> int:
        return n.bit_length() - 1

    def parts_of(self, level: int) -> list[int] | None:
        """Parts of each class for sets of 2^level to 2^(level + 1) - 1 tokens; None if some set of these could run out of
        tokens before its prefix is complete: then every token is a key."""
        if level not in self.parts:
            need = self.missing(3 << level >> 1) + 1
            parts = []
            for k in self.sizes:  # of SHARE tokens in a part, Poisson, so many keep a combination
                left = SHARE - k + 1 + sum((k - 1 - i) * np.exp(-SHARE) * SHARE**i / float(np.prod(range(1, i + 1))) for i in range(k - 1))
                parts.append(max(1, round(need / left)))
            lost = sum(p * (k - 1) for p, k in zip(parts, self.sizes))
            smallest, largest = 1 << level, (2 << level) - 1  # n - missing(n) never falls as n grows
            self.parts[level] = parts if smallest - self.missing(smallest) - 1 >= lost and largest - self.missing(largest) - 1 >= lost else None
        return self.parts[level]

    def of(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """Keys of a set of n shingles by their tokens, ascending, as signed 64-bit numbers; none of an empty set. Shingles of
        one token, if any, count as one: a partner has that token or misses both."""
        if not n:
            return np.zeros(0, np.int64)
        tokens = np.unique(tokens)
        kind = np.full(len(tokens), -1)
        if len(self.tokens):
            near = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            kind = np.where(self.tokens[near] == tokens, self.kinds[near], -1)
        found = []
        for level in sorted({self.level(n), self.level(int(n / self.s))}):
            self._of_level(tokens, kind, level, self.missing(n) + 1, found)
        return np.unique(np.concatenate(found)).view(np.int64)

    def _of_level(self, tokens: np.ndarray, kind: np.ndarray, level: int, need: int, found: list) -> None:
        parts = self.parts_of(level)
        if parts is None:
            order = np.argsort(kind, kind="stable")
            found.append(_mix(tokens[order[:need]]))
            return
        rare = tokens[kind < 0][:need]
        found.append(_mix(rare))
        need -= len(rare)
        for c, k in enumerate(self.sizes):
            own = tokens[kind == c]
            if need <= 0 or not len(own):
                continue
            part = (_mix(own ^ np.uint64(level + 1)) % np.uint64(parts[c])).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = np.concatenate([[True], part[order][1:] != part[order][:-1]])
            place = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            counts = np.zeros(len(own), bool)
            counts[order] = place >= k - 1
            total = np.cumsum(counts)
            end = int(np.searchsorted(total, need)) + 1 if total[-1] >= need else len(own)
            need -= int(total[end - 1])
            members: dict[int, list[int]] = {}
            for p, t in zip(part[:end].tolist(), own[:end].tolist()):
                members.setdefault(p, []).append(t)
            made = [x for group in members.values() for x in combinations(group, k)]
            if made:
                columns = np.array(made, np.uint64)
                key = np.full(len(made), np.uint64(level + 1))
                for j in range(k):
                    key = _mix(key ^ columns[:, j])
                found.append(key)


def wide_parities(hashes: np.ndarray) -> bytes:
    """As many bits as shingles at least, and BITS at least."""
    return parities(hashes, max(BITS, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 0))


def _sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Written: doc_id, fp (digest of the set), n (its size), bits (its wide parities) and members (its tokens, packed) of
    every row of docs."""
    names = ["doc_id", "fp", "n", "bits", "members"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for at in range(0, len(texts), 500):
                rows = []
                for t in texts.slice(at, 500):
                    whole = np.unique(simhash.shingle_hashes(t.as_py(), shingle, seed))
                    rows.append((digest_of(whole), len(whole), wide_parities(whole), packed(whole >> np.uint64(64 - 8 * BYTES))))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), *columns], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint, n bigint, bits binary, members binary"
    return written(docs.select("doc_id", "text").mapInArrow(lambda b: given_back(of(b)), schema), "token-sets")


def _frequent(sets: DataFrame, classes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, ascending, and the class of each. All sets are counted, in stretches of about 2^21 tokens; a
    token that a stretch has once does not count there. Classes decide how keys are made and never which pairs they find."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for m in batch.column(0):
                held.append(unpacked(m.as_buffer()))
                size += len(held[-1])
                if size > 1 << 21:
                    yield several(held)
                    held, size = [], 0
        if held:
            yield several(held)

    def several(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    counts = sets.select("members").mapInArrow(lambda b: given_back(count(b)), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= classes[0][0]).orderBy(F.desc("n"), "token").limit(most).collect()
    tokens, n = np.array([r["token"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(tokens)
    return tokens[order], np.searchsorted([c[0] for c in classes], n[order], side="right") - 1


def _shared(sets: DataFrame, keys: Keys, s: Fraction) -> DataFrame:
    """Written: what the keys that several sets have lead to, keys being moved once. Rows key, size, fp, n of the sets of a long
    key, size being how many it has, and rows fp, other of the first pairs of any key, whose key is null."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found, owner = [], []
            for i, (fp, n, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                if fp not in seen:  # equal sets have equal keys
                    seen.add(fp)
                    found.append(keys.of(unpacked(m.as_buffer()), n))
                    owner.append(np.full(len(found[-1]), i))
            if found:
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(1).take(at), batch.column(0).take(at)], ["key", "n", "fp"])

    rows = sets.filter("n > 0").select("fp", "n", "members").mapInArrow(lambda b: given_back(emit(b)), "key bigint, n bigint, fp bigint")
    dealt = rows.repartition("key").sortWithinPartitions("key", "n", "fp")
    return written(dealt.mapInArrow(lambda b: given_back(_met(s)(b)), "key bigint, size bigint, fp bigint, other bigint, n bigint"), "shared-keys")


def _met(s: Fraction):
    """Rows as of _shared from sorted rows (key, n, fp), which may repeat."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_runs(batches):
            key, n, fp = (rows.column(i).to_numpy() for i in range(3))
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
            count = np.add.reduceat(fresh.astype(np.int64), bounds[:-1])
            take = fresh & np.repeat(count > 1, np.diff(bounds))
            size = count[count > 1]
            if not len(size):
                continue
            key, n, fp = key[take], n[take], fp[take]
            long = np.repeat(size, size) > SHORT
            if long.any():
                none = pa.nulls(int(long.sum()), pa.int64())
                yield _met_rows(pa.array(key[long]), pa.array(np.repeat(size, size)[long]), pa.array(fp[long]), none, pa.array(n[long]))
            a, b = _first_pairs(size, n, s)
            if len(a):
                both = _pairs(fp[a], fp[b])
                none = pa.nulls(both.num_rows, pa.int64())
                yield _met_rows(none, none, *both.columns, none)

    return find


def _met_rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["key", "size", "fp", "other", "n"])


def _first_pairs(size: np.ndarray, n: np.ndarray, s: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of sets, given how many the keys have and, key by key, their sizes n, ascending in a key: all of a short
    key; in a longer one, each set with the smallest of about its size."""
    a, b = [], []
    bounds, run = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(len(size)), size)
    for step in range(1, SHORT):
        i = np.flatnonzero((run[step:] == run[:-step]) & (size[run[step:]] <= SHORT))
        a.append(i)
        b.append(i + step)
    for r in np.flatnonzero(size > SHORT).tolist():
        x, y = int(bounds[r]), int(bounds[r + 1])
        while x < y:
            end = x + int(np.searchsorted(n[x:y], int(n[x] / s), side="right"))
            a.append(np.full(end - x - 1, x))
            b.append(np.arange(x + 1, end))
            x = end
    a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    good = n[a] * s.denominator >= n[b] * s.numerator
    return a[good], b[good]


def _pairs(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.column_stack([np.minimum(one, two), np.maximum(one, two)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _likely(rows: DataFrame, wanted: DataFrame, name: str = "fp") -> DataFrame:
    """The rows whose name, a 64-bit hash, is among wanted, and few others: a bitmap, bounded in size, drops most of them before
    rows are moved, and what follows decides."""
    bit = F.pmod(name, F.lit(BITMAP))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    held = rows.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word")
    return held.filter(F.expr("getbit(mask, cast(bit & 63 as int)) = 1")).select(*rows.columns)


def _one_by_one(pairs: DataFrame, sets: DataFrame, column: str, decode, fits) -> DataFrame:
    """Those of the different pairs a, b for which fits(n of a, n of b, value of a, value of b) holds; decode makes a value of
    what the column holds.

    Pairs of one family are looked at together, so that a set travels once for all of them, not once for each: a family is
    what has one smallest neighbour, and families of more than GROUP sets are cut in parts, each pair of parts being a task.
    """
    ends = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    nodes = written(ends.groupBy("fp").agg(F.min("other").alias("other")).select("fp", F.least("fp", "other").alias("family")), "families")
    parts = nodes.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("bigint").alias("parts"))
    sized = nodes.join(parts, "family")
    one, two = (sized.select(F.col("fp").alias(k), F.col("family").alias(f"family_{k}"), F.col("parts").alias(f"parts_{k}")) for k in "ab")
    first = F.col("family_a") <= F.col("family_b")
    within = F.when(first, F.col("parts_a")).otherwise(F.col("parts_b"))
    x, y = (F.pmod(F.xxhash64(k), within) for k in "ab")
    task = F.xxhash64(F.least("family_a", "family_b"), F.least(x, y), F.greatest(x, y))
    placed = written(pairs.join(one, "a").join(two, "b").select(task.alias("task"), "a", "b"), "placed-pairs")
    wanted = placed.select("task", F.col("a").alias("fp")).union(placed.select("task", "b")).distinct()
    values = _likely(sets.select("fp", "n", F.col(column).alias("v")), nodes.select("fp")).groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("v").alias("v"))
    rows = wanted.join(values, "fp").select("task", F.lit(0).alias("side"), F.col("fp").alias("a"), F.lit(0).cast("bigint").alias("b"), "n", "v")
    rows = rows.unionByName(placed.select("task", F.lit(1).alias("side"), "a", "b", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("v")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_runs(batches):
            side, a, b, n = (table.column(i).to_numpy() for i in range(1, 5))
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                cut = x + int((side[x:y] == 0).sum())
                held = {fp: (size, decode(v.as_buffer())) for fp, size, v in zip(a[x:cut].tolist(), n[x:cut].tolist(), table.column(5).slice(x, cut - x))}
                good = []
                for i, j in zip(a[cut:y].tolist(), b[cut:y].tolist()):
                    (n_i, v_i), (n_j, v_j) = held[i], held[j]
                    good.append(fits(n_i, n_j, v_i, v_j))
                good = np.array(good, bool)
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[cut:y][good]), pa.array(b[cut:y][good])], ["a", "b"])

    dealt = rows.repartition("task").sortWithinPartitions("task", "side")
    return dealt.mapInArrow(lambda batches: given_back(check(batches)), "a bigint, b bigint")


def _near(pairs: DataFrame, sets: DataFrame, s: Fraction) -> DataFrame:
    """Written: the different pairs a, b but those whose parities are too far apart; the wider ones are folded."""

    def fits(n: int, m: int, one: np.ndarray, two: np.ndarray) -> bool:
        width = min(len(one), len(two))
        x, y = (np.bitwise_xor.reduce(w.reshape(-1, width), axis=0) for w in (one, two))
        return int(np.bitwise_count(x ^ y).sum()) <= most_apart(n + m, s)

    return written(_one_by_one(pairs, sets, "bits", lambda raw: np.frombuffer(raw, np.uint64), fits), "close-pairs")


def _verified(pairs: DataFrame, sets: DataFrame, s: Fraction) -> DataFrame:
    """Written: those of the different pairs a, b whose sets are similar."""

    def fits(n: int, m: int, one: np.ndarray, two: np.ndarray) -> bool:
        return _similar(one, two, n + m, s)

    return written(_one_by_one(pairs, sets, "members", lambda raw: np.unique(unpacked(raw)), fits), "similar-pairs")


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """pair, side, fp, root, n: rows (key, fp, root, n) in blocks of a key, once for each pair of blocks that holds
    several roots. Roots with many rows in a key have blocks of their own, so blocks of one root do not meet each other."""
    own = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
    own = written(own, "roots-of-keys")
    small = own.filter(F.col("own") * 2 <= block).groupBy("key").agg(F.sum("own").alias("small"))
    parts = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("bigint")
    hashed = lambda *c: F.xxhash64(*c)
    named = rows.join(own, ["key", "root"]).join(small, "key", "left")
    large = hashed("root", F.pmod(hashed("fp"), parts("own")))
    label = F.when(F.col("own") * 2 > block, large).otherwise(F.pmod(hashed("root"), parts("small")))
    named = written(named.withColumn("block", label).select("key", "block", "fp", "root", "n"), "blocks-of-keys")
    blocks = named.groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    one, two = (blocks.select("key", F.col("block").alias(f"block_{k}"), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}")) for k in "xy")
    met = one.join(two, "key").filter("block_x <= block_y and least(low_x, low_y) <> greatest(high_x, high_y)")
    met = written(met.select("key", "block_x", "block_y", hashed("key", "block_x", "block_y").alias("pair")), "pairs-of-blocks")
    sides = []
    for side, k in enumerate("xy"):
        at = met if side == 0 else met.filter("block_x <> block_y")
        sides.append(named.join(at.select("key", F.col(f"block_{k}").alias("block"), "pair"), ["key", "block"]).select("pair", F.lit(side).alias("side"), "fp", "root", "n"))
    return sides[0].unionByName(sides[1])


def _near_in_block(side: np.ndarray, root: np.ndarray, n: np.ndarray, raw: list[bytes], s: Fraction) -> np.ndarray:
    """By pairs of rows of two blocks, or of one: whether sizes, roots and parities leave it open that they are similar."""
    m = len(root)
    near = np.zeros((m, m), bool)
    cross = (side == 1).any()
    width = np.fromiter(map(len, raw), np.int64, m)
    for w in np.unique(width).tolist():  # sets of similar sizes have one width, or one of them has twice the other's
        own = np.flatnonzero((width == w) | (width == 2 * w))
        bits = np.array([np.bitwise_xor.reduce(np.frombuffer(raw[i], np.uint64).reshape(-1, w // 8), axis=0) for i in own.tolist()])
        for k in np.flatnonzero(width[own] == w).tolist():
            i = own[k]
            ok = (root[own] != root[i]) & (np.minimum(n[own], n[i]) * s.denominator >= np.maximum(n[own], n[i]) * s.numerator)
            if cross:
                ok &= side[own] != side[i]
            at = np.flatnonzero(ok)
            if len(at):
                hit = own[at[np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1) <= most_apart(n[own[at]] + n[i], s)]]
                near[i, hit] = near[hit, i] = True
    return near


def _open_ends(s: Fraction):
    """The rows (pair, side, fp, root, n) of sorted rows (pair, side, fp, root, n, bits) that may be similar to another of their
    pair of blocks and of another root."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_runs(batches):
            side, _, root, n = (rows.column(i).to_numpy() for i in range(1, 5))
            raw = rows.column(5).to_pylist()
            near = [_near_in_block(side[x:y], root[x:y], n[x:y], raw[x:y], s).any(axis=1) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            take = np.flatnonzero(np.concatenate(near)) if near else np.zeros(0, np.int64)
            if len(take):
                yield from rows.take(pa.array(take)).drop_columns(["bits"]).combine_chunks().to_batches()

    return find


def _similar(one: np.ndarray, two: np.ndarray, n: int, s: Fraction) -> bool:
    """Whether two sets of n tokens together are similar; different tokens, ascending."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    shared = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return shared * s.denominator >= (n - shared) * s.numerator


def _links_at_home(s: Fraction, decode):
    """Links a, b of sorted rows (home, kind, pair, side, fp, root, n, bits, members): similar sets of one pair of blocks, as many
    as connect with equal roots what all of them connect. Rows of kind 0 are the sets of a home, each once, those of
    kind 1 say which pairs of blocks they are in. Sets are verified here, so nothing is given out for what is not similar."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_runs(batches):
            kind, pair, side, fp, root, n = (rows.column(i).to_numpy() for i in range(1, 7))
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                cut = x + int((kind[x:y] == 0).sum())
                bits, members = (rows.column(i).slice(x, cut - x).to_pylist() for i in (7, 8))
                place = {v: i for i, v in enumerate(fp[x:cut].tolist())}
                at = np.fromiter((place[v] for v in fp[cut:y].tolist()), np.int64, y - cut)
                found = links(fp[x:cut], n[x:cut], bits, members, at, pair[cut:y], side[cut:y], root[cut:y])
                if found:
                    yield _pairs(*np.array(found, np.int64).T)

    def links(fp, n, bits, members, at, pair, side, root):
        label = np.unique(root, return_inverse=True)[1]
        join, found, refused, held = np.arange(len(label) + 1), [], set(), {}
        for a, b in _runs(pair):
            own = at[a:b]
            i, j = np.nonzero(np.triu(_near_in_block(side[a:b], join[label[a:b]], n[own], [bits[k] for k in own.tolist()], s)))
            for p, q, k, m in zip(own[i].tolist(), own[j].tolist(), label[a:b][i].tolist(), label[a:b][j].tolist()):
                both = (p, q) if p < q else (q, p)
                if join[k] == join[m] or both in refused:
                    continue
                for v in both:
                    if v not in held:
                        held[v] = np.unique(decode(members[v]))
                if _similar(held[p], held[q], int(n[p] + n[q]), s):
                    found.append((int(fp[p]), int(fp[q])))
                    join[join == join[m]] = join[k]
                else:
                    refused.add(both)
        return found

    return find


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal values."""
    bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(bounds[:-1], bounds[1:])) if len(values) else []


def _roots(links: DataFrame) -> DataFrame:
    return written(components(links).withColumnRenamed("node", "fp"), "set-roots")


def _open_blocks(shared: DataFrame, roots: DataFrame, sets: DataFrame, block: int) -> tuple[DataFrame, DataFrame] | None:
    """pair, side, fp, n of the sets of all keys which the first pairs need not have compared, as _rest takes them, and fp, bits
    of the sets there; None if there is no such key. A key of up to `block` sets is one block, a larger one goes
    through _block_pairs if it has several components."""
    rows = shared.filter("key is not null")
    if rows.isEmpty():
        return None
    blocks = rows.filter(F.col("size") <= block).select(F.xxhash64("key").alias("pair"), F.lit(0).alias("side"), "fp", "n")
    large = rows.filter(F.col("size") > block)
    if not large.isEmpty():
        rooted = written(large.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"), "n"), "rooted-keys")
        several = written(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key"), "open-keys")
        cut = written(_block_pairs(rooted.join(several, "key", "left_semi"), block), "rows-of-blocks")
        blocks = blocks.unionByName(cut.drop("root"))
    bits = _likely(sets.select("fp", "bits"), rows.select("fp")).groupBy("fp").agg(F.any_value("bits").alias("bits"))
    return blocks, bits


def _dealt(blocks: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows (pair, side, fp, root, n) with bits, by pair of blocks."""
    return blocks.join(bits, "fp").select("pair", "side", "fp", "root", "n", "bits").repartition("pair").sortWithinPartitions("pair", "side", "fp")


def _rest(blocks: DataFrame, roots: DataFrame, bits: DataFrame, sets: DataFrame, s: Fraction, decode=unpacked) -> DataFrame:
    """Written: links a, b that connect all similar sets of each pair of blocks, given the roots; blocks: pair, side, fp, n.
    sets: fp, n, bits, members, of which decode makes tokens.

    Near copies share many keys. What two blocks compare is sent to a home, named by the smallest set of either that is
    still open, so that a set travels once to a home for all keys that lead there, and is verified there. A home has as many
    pairs of blocks as two sets share keys.
    """
    rooted = blocks.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted.select("pair", "side", "fp", "root", "n"), "blocks-again")
    several = rooted.groupBy("pair").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("pair")
    schema = "pair bigint, side int, fp bigint, root bigint, n bigint"
    ends = written(_dealt(_likely(rooted, several, "pair"), bits).mapInArrow(lambda b: given_back(_open_ends(s)(b)), schema), "open-ends")
    least = [F.min(F.when(F.col("side") == i, F.col("fp"))) for i in (0, 1)]
    homes = ends.groupBy("pair").agg(F.xxhash64(*least).alias("home"))
    placed = written(ends.join(homes, "pair").select("home", "pair", "side", "fp", "root"), "homes-of-blocks")
    wanted = placed.select("home", "fp").distinct()
    values = _likely(sets.select("fp", "n", "bits", "members"), placed.select("fp")).groupBy("fp").agg(*(F.any_value(c).alias(c) for c in ("n", "bits", "members")))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("binary")
    rows = wanted.join(values, "fp").select("home", F.lit(0).alias("kind"), zero.alias("pair"), F.lit(0).alias("side"), "fp", zero.alias("root"), "n", "bits", "members")
    rows = rows.unionByName(placed.select("home", F.lit(1).alias("kind"), "pair", "side", "fp", "root", zero.alias("n"), none.alias("bits"), none.alias("members")))
    dealt = rows.repartition("home").sortWithinPartitions("home", "kind", "pair", "side", "fp")
    return written(dealt.mapInArrow(lambda b: given_back(_links_at_home(s, decode)(b)), "a bigint, b bigint"), "links-at-home")


def similar_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: Fraction = SIMILARITY, seed: int = 42, classes=CLASSES, frequent: int = FREQUENT, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id (the smallest doc_id reachable over similar pairs, its own
    included) of every row of docs (doc_id, text; other columns are not read, whatever their names).

    A set holds the different shingles of `shingle` words, of a shorter text all its words as one; words are as in simhash.
    Null and empty texts and those of white space have empty sets, which are linked with nothing, so their component_id is
    their own doc_id. Equal sets are linked. Texts count whole, however long. Rows that repeat are rows of one component; a
    null doc_id is a component_id only where there is no other. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    s = Fraction(similarity)
    sets = _sets(docs, shingle, seed)
    tokens, kinds = _frequent(sets, classes, frequent)
    shared = _shared(sets, Keys(tokens, kinds, s, classes), s)
    tried = written(shared.filter("key is null").select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct(), "first-pairs")
    links = _verified(_near(tried, sets, s), sets, s)
    roots = _roots(links)
    opened = _open_blocks(shared, roots, sets, block)
    if opened is not None:
        blocks, bits = opened
        similar = _rest(blocks, roots, bits, sets, s)
        if not similar.isEmpty():
            roots = _roots(links.unionByName(similar))
    least = sets.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = written(least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "least-of-sets")
    best = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least-of-components")
    ids = written(named.join(best, "root").select("fp", "component_id"), "component-ids")
    linked = sets.filter("n > 0").select("doc_id", "n", "fp").join(ids, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
