"""SimHash near-duplicates, with candidates found by the pigeonring principle.

The 64 bits of a fingerprint lie in a ring of `len(WIDTHS)` segments. Where two fingerprints differ in at most LIMIT
bits, there is a segment from which on every chain of l consecutive segments differs in at most l * LIMIT / segments
bits, rounded down: 0, 1, 2, 3, 4. So they agree in a whole segment and in either half of the next one, which is the
key that brings candidates together; the longer chains then prune them, and the whole ring is the Hamming check.

A key that many fingerprints have grows longer: of LIMIT + 1 parts of the bits that it leaves free, two linked ones agree
in one at least. Each round sets a part of what was free, so keys end with few fingerprints whatever the data.

Documents of one fingerprint are one node. Within a key only as many links are given out as connect what is linked, so
a group of near copies never yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .components import components
from .exact_dedup import matching_rows, row_key
from .memory import given_back
from .store import written
from .words import texts_of

LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
#: Runs of one key up to this length are compared pair by pair; longer ones are searched from link to link.
SHORT = 8
#: Keys of more fingerprints than this grow longer.
HOT = 2_000


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle in order, repeats included; a shorter text is one shingle, no word gives none."""
    words = text.encode().lower().split()  # for bytes, lower() changes A-Z and split() parts at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(begins.tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter((digest(line[s:e], seed) for s, e in spans), np.uint64, max(1, len(words) - shingle + 1))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """Bits that over half of the hashes have, as a signed 64-bit number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[a : a + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, row (row_key) and fp of every row of docs, from whole texts; null counts as empty."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seed) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "row", "fp"])

    rows = docs.select("doc_id", row_key(docs).alias("row"), "text")
    return rows.mapInArrow(lambda batches: given_back(of(batches)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row bigint, fp bigint")


def _starts() -> list[int]:
    return [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]


def _mask(first: int, chain: int) -> int:
    """Bits of `chain` segments from `first` on, around the ring."""
    at = _starts()
    return sum(((1 << WIDTHS[i % len(WIDTHS)]) - 1) << at[i % len(WIDTHS)] for i in range(first, first + chain))


def _halves(segment: int) -> tuple[int, int]:
    at, width = _starts()[segment], WIDTHS[segment]
    low = ((1 << width // 2) - 1) << at
    return low, (((1 << width) - 1) << at) & ~low


def _key_masks() -> list[int]:
    """Bits that a key fixes: segment k // 2 and one half of the segment after it."""
    return [_mask(i, 1) | half for i in range(len(WIDTHS)) for half in _halves((i + 1) % len(WIDTHS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(prints: DataFrame) -> DataFrame:
    """A row for each key of each fingerprint: k (which key), mask (the bits it fixes), bits (their values), fp."""
    masks = [F.lit(_signed(m)).cast("bigint") for m in _key_masks()]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), m.alias("mask"), F.col("fp").bitwiseAND(m).alias("bits")) for k, m in enumerate(masks)])
    return prints.select("fp", F.explode(keys).alias("x")).select("x.k", "x.mask", "x.bits", "fp")


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links a, b between different fingerprints that differ in at most LIMIT bits: enough to connect all that are.

    prints: fp, each value once.
    """
    ship(prints.sparkSession)
    rows = written(keyed(prints), "keys")
    found, hot = None, max(hot, 1 << LIMIT)  # where LIMIT bits are free, no more fingerprints can share a key
    while True:
        large = written(rows.groupBy("k", "mask", "bits").count().filter(F.col("count") > hot).select("k", "mask", "bits"), "hot-keys")
        last = large.isEmpty()
        plain = rows if last else rows.join(large, ["k", "mask", "bits"], "left_anti")
        dealt = plain.repartition("mask", "bits").sortWithinPartitions("k", "mask", "bits", "fp").select("k", "mask", "bits", "fp")
        some = dealt.mapInArrow(_link_runs, "a bigint, b bigint")
        found = some if found is None else found.unionByName(some)
        if last:
            return found.distinct()
        rows = written(rows.join(large, ["k", "mask", "bits"], "left_semi").select("k", "mask", "fp").mapInArrow(_longer, "k int, mask bigint, bits bigint, fp bigint").distinct(), "longer-keys")


@lru_cache(maxsize=4096)
def _longer_masks(mask: int) -> np.ndarray:
    """The mask with each of LIMIT + 1 parts of its free bits; where fewer are free, the mask of all bits ends the way."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= LIMIT:
        return np.array([-1], np.int64)
    parts = [sum(1 << b for b in free[i :: LIMIT + 1]) for i in range(LIMIT + 1)]
    return np.array([_signed(mask | p) for p in parts], np.int64)


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows k, mask, fp with every longer key: k, mask, bits, fp."""
    for batch in batches:
        k, mask, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for m in np.unique(mask).tolist():
            own = mask == m
            for longer in _longer_masks(m & (1 << 64) - 1).tolist():
                columns = (k[own].astype(np.int32), np.full(own.sum(), longer), fp[own] & np.int64(longer), fp[own])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "mask", "bits", "fp"])


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last run of a batch waits for the next batch, which may go on with it."""
    rest = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        k, mask, bits, fp = now
        if not len(k):
            continue
        new = np.flatnonzero((k[1:] != k[:-1]) | (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
        last = int(new[-1]) if len(new) else 0
        rest = [x[last:] for x in now]
        if last:
            yield from _link_whole_runs(k[:last], fp[:last], np.concatenate([[0], new]))
    if rest is not None:
        yield from _link_whole_runs(rest[0], rest[3], np.array([0, len(rest[0])]))


def _link_whole_runs(k: np.ndarray, fp: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    fp, size = fp.view(np.uint64), np.diff(bounds)
    first = (k // 2).astype(np.int64)
    chains = np.array([[_mask(i, n) for n in range(2, len(WIDTHS) + 1)] for i in range(len(WIDTHS))], np.uint64)
    budgets = [n * LIMIT // len(WIDTHS) for n in range(2, len(WIDTHS) + 1)]

    def near(differ: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Places whose chains all stay within their budgets; the last chain is the whole ring."""
        at = np.arange(len(differ))
        for c, most in enumerate(budgets):
            mask = masks[c] if masks.ndim == 1 else masks[at, c]
            at = at[np.bitwise_count(differ[at] & mask) <= most]
        return at

    pairs = []
    run = np.repeat(np.arange(len(size)), size)
    for step in range(1, SHORT):
        i = np.flatnonzero((run[step:] == run[:-step]) & (size[run[step:]] <= SHORT))
        if not len(i):
            break
        hit = i[near(fp[i] ^ fp[i + step], chains[first[i]])]
        pairs.append((fp[hit], fp[hit + step]))
    for r in np.flatnonzero(size > SHORT).tolist():
        pairs.append(_search(fp[bounds[r] : bounds[r + 1]], lambda d, m=chains[first[bounds[r]]]: near(d, m)))
    if pairs:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_pydict({"a": a[at : at + 100_000], "b": b[at : at + 100_000]})


def _search(fp: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """From each value to all not yet reached: one link for each value that is reached."""
    left, a, b, queue = fp, [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        value = queue.pop()
        if not len(left):
            break
        hit = near(left ^ value)
        if len(hit):
            got = left[hit]
            a.append(np.full(len(got), value, np.uint64))
            b.append(got)
            queue.extend(got)
            left = np.delete(left, hit)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _roots(prints: DataFrame, hot: int) -> DataFrame:
    """fp and root (the smallest fingerprint reachable over links) of every fingerprint."""
    nodes = written(prints.select("fp").distinct(), "fingerprint-nodes")
    roots = components(links(nodes, hot)).withColumnRenamed("node", "fp")
    return written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")


def rooted(docs: DataFrame, shingle: int = 4, seed: int = 42, hot: int = HOT) -> DataFrame:
    """doc_id, row, fp and root of every row of docs."""
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    return prints.join(_roots(prints, hot), "fp").select("doc_id", "row", "fp", "root")


def near_groups(docs: DataFrame, shingle: int = 4, seed: int = 42, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row of docs.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any others. Rows that repeat
    count once each. A null doc_id is never a component_id unless its component has no other. Texts count whole, however long,
    and columns other than doc_id and text only for telling rows apart, whatever their names. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    named = _roots(prints, hot)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    least = written(least, "least-of-components")
    ids = written(named.join(least, "root").select("fp", "component_id"), "component-ids")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 4, seed: int = 42, hot: int = HOT) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component, that of the smallest doc_id."""
    return kept_rows(docs, rooted(docs, shingle, seed, hot))


def kept_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each root of groups (doc_id, row, root, a row for each row of docs), with all columns.

    That of the smallest doc_id stays, a null one only where there is no other; where it repeats, the row of the smallest
    key. Components are told apart by their roots, since several may have one doc_id. Columns travel as one struct, so no
    name of theirs can clash with a name used here.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    best = groups.groupBy("root").agg(least).select("least.doc_id", F.col("least.row").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", row_key(docs, "row"))
    return matching_rows(rows, written(best, "kept-rows")).select("row.*")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
