"""Removal of long repeated byte strings, by suffix arrays.

Every string of WINDOW bytes that starts at two places of the corpus has to go, wherever it stands.

1. Anchors. Among the GRAM-byte strings of a window, the one with the smallest hash is its anchor. Equal windows have
   equal anchors at equal places, so only windows whose anchor occurs twice can repeat. The windows of one anchor place
   lie next to each other; the bytes that they cover are the anchor's context.
2. Contexts of repeated anchors go to the task of their anchor. Equal contexts travel as one, with a weight.
3. There, a suffix array over the contexts is made by two-stage sorting: only suffixes smaller than their successors are
   sorted directly; all others are induced by scanning the buckets of first bytes in ascending order. The common
   prefixes of neighbours in the array then show which windows occur twice.
4. Windows found so are merged to spans by document and cut out of the texts.

An anchor with very many contexts is split by the bytes beside it. Its windows are told apart by how far behind their
start it lies: windows within some range of that share the bytes around the anchor that the range leaves common, so these
bytes are a longer key. Ranges shrink until few contexts share a key; in the end a range is one place, and its key all
bytes of a window.

The same arrays show strings of SHORT bytes that repeat, and these are counted as well. They are not all there are: two
places of a string shorter than WINDOW meet only where it holds the anchor of both, as most strings of 300 bytes do, and
behind the windows of a context only some places are looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .memory import given_back
from .store import written
from .texts import Cuts, flattened, merged, numbered

WINDOW = 400
#: Repeated strings of this many bytes are counted, but stay.
SHORT = 200
GRAM = 32
#: Keys of more different contexts than this are split.
HOT = 256
#: By how much the range of places behind a longer key shrinks.
FINER = 4
#: Bytes of contexts that are sorted together; a single group of one key may be larger.
BLOCK = 1 << 18

_ODD = 0x9E3779B97F4A7C15
_ODD_2 = 0xD6E8FEB86659FD93
_PLACE_BITS = 24
_PIECE = 1 << 20


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class _Hasher:
    """Hashes of any substrings of one byte string, from prefix sums modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.back = base, _inverse(base)
        self.up, self.down = _powers(base, 0), _powers(self.back, 0)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = _powers(self.base, 2 * len(data)), _powers(self.back, 2 * len(data))
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])

    def spans(self, prefix: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice, place: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (prefix[end] - prefix[begin]) * self.down[place]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(29))


#: For hashes within blocks of contexts.
_BLOCKS = _Hasher(_ODD)


def anchors(data: np.ndarray, hasher: _Hasher, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of one text: anchor hash, a digest of the context, and the first and last window start of each anchor.

    A text shorter than the window has none. Long texts are taken piece by piece, so memory does not grow with them
    beyond a few numbers a byte. Contexts of one anchor are told apart by 64 bits of a digest of their bytes.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = hasher.prefix(data)
    m = len(data) - gram + 1
    hashes = hasher.spans(prefix, slice(0, m), slice(gram, gram + m), slice(0, m))
    at = _smallest(hashes, window - gram + 1)  # place of the anchor of each window
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    low, high = cuts, np.r_[cuts[1:], len(at)] - 1
    return hashes[at[cuts]], _digests(data, at[cuts], low, high, window), low, high


def _digests(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """Of contexts: 64 bits of a BLAKE2b digest of their bytes and of where in them the windows stand relative to the anchor."""
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    own = b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(low.tolist(), (high + window).tolist())])
    with np.errstate(over="ignore"):
        shape = ((at - low).astype(np.uint64) << np.uint64(20)) ^ (high - low).astype(np.uint64)
        return np.frombuffer(own, "<u8") ^ (shape * np.uint64(_ODD_2))


def _smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash in each run of `width`, the leftmost of equal ones."""
    found = []
    total = len(hashes) - width + 1
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    for a in range(0, total, _PIECE):
        b = min(total, a + _PIECE)
        key = (hashes[a : b + width - 1] & ~mask) | np.arange(b - a + width - 1, dtype=np.uint64)
        done = 1
        while done < width:  # minima of runs of 1, 2, 4, ... places
            step = min(done, width - done)
            key = np.minimum(key[:-step], key[step:])
            done += step
        found.append((key & mask).astype(np.int64) + a)
    return np.concatenate(found)


@dataclass
class Sorted:
    """Bytes with what their suffixes are compared by: the eight bytes from each place on as a big-endian number, and a
    hash of the `depth` bytes from there; zeros stand behind the end."""

    data: np.ndarray
    depth: int
    padded: np.ndarray
    key: np.ndarray
    digest: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, depth: int) -> Sorted:
        padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
        key = padded.astype(np.uint64)
        for width in (1, 2, 4):
            key = (key[:-width] << np.uint64(8 * width)) | key[width:]
        prefix = _BLOCKS.prefix(padded)
        n = len(data)
        return cls(data, depth, padded, key, _BLOCKS.spans(prefix, slice(0, n), slice(depth, depth + n), slice(0, n)))


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of data by their first `depth` bytes at least; data counts as followed by zeros."""
    return _suffix_array(Sorted.of(data, depth))


def _suffix_array(text: Sorted, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes in order; with wanted, a mask of places, only those that it names or that their order hangs on:
    up to the next suffix that is smaller than its successor, as all between are induced from it."""
    data, n = text.data, len(text.data)
    if not n:
        return np.zeros(0, np.int64)
    smaller, run = _types(data)
    if wanted is None:
        wanted = np.ones(n, bool)
    else:
        named = np.flatnonzero(wanted)
        stops = np.append(np.flatnonzero(smaller), n - 1)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, named, 1)
        np.add.at(change, stops[np.searchsorted(stops, named)] + 1, -1)
        wanted = np.cumsum(change[:-1]) > 0
    rank = np.empty(n, np.int64)
    large = np.flatnonzero(wanted & ~smaller)
    counts = np.bincount(data[wanted], minlength=256)
    bucket = np.cumsum(counts) - counts
    large_in = np.bincount(data[large], minlength=256)
    # First stage: the suffixes smaller than their successors. In each bucket they follow the others.
    order = _direct_order(text, np.flatnonzero(wanted & smaller))
    small_in = np.bincount(data[order], minlength=256)
    rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(small_in) - small_in, small_in) + np.repeat(bucket + large_in, small_in)
    # Second stage: a suffix larger than its successor starts with a byte no smaller than that of its successor. So a
    # scan of the buckets in ascending order finds every successor in place; in a run of one byte, the longer run is larger.
    large = large[np.argsort(data[large], kind="stable")]
    ends = np.cumsum(large_in)
    for byte in np.flatnonzero(large_in).tolist():
        own = large[ends[byte] - large_in[byte] : ends[byte]]
        after = own + run[own]
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        own = own[np.argsort(run[own] * (n + 1) + follow)]  # no two suffixes have the same successor and run
        rank[own] = bucket[byte] + np.arange(len(own))
    places = np.flatnonzero(wanted)
    out = np.empty(len(places), np.int64)
    out[rank[places]] = places
    return out


def _types(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than its successor, and how many equal bytes start at each place."""
    n = len(data)
    last = np.flatnonzero(np.r_[data[1:] != data[:-1], True])  # last place of each run
    size = np.diff(last, prepend=-1)
    rises = np.r_[data[last[:-1]] < data[last[:-1] + 1], False]
    return np.repeat(rises, size), np.repeat(last, size) - np.arange(n) + 1


def _direct_order(text: Sorted, places: np.ndarray) -> np.ndarray:
    """The given suffixes in order: by eight bytes at a time, each time only those still tied.

    Suffixes whose first `depth` bytes have one hash stay together from the first tie on and are compared as one.
    """
    key, digest = text.key, text.digest
    order = places[np.argsort(key[places])]
    value = key[order]
    new = np.r_[True, value[1:] != value[:-1]][: len(order)]
    tied = np.flatnonzero(~new | ~np.r_[new[1:], True][: len(order)])
    if not len(tied):
        return order  # also where nothing is to be sorted
    own, group = order[tied], np.cumsum(new)[tied]
    again = np.lexsort((digest[own], group))
    own, group = own[again], group[again]
    first = np.r_[True, (digest[own][1:] != digest[own][:-1]) | (group[1:] != group[:-1])]
    alike, some = np.cumsum(first) - 1, own[first]
    rank = np.empty(len(some), np.int64)
    rank[_refined(text, some, group[first])] = np.arange(len(some))
    order[tied] = own[np.argsort(rank[alike], kind="stable")]
    return order


def _refined(text: Sorted, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places' indices in order; groups ascend and their members agree in the first eight bytes."""
    order, n = np.arange(len(places)), len(text.data)
    new = np.r_[True, group[1:] != group[:-1]]
    tied = np.flatnonzero(~new | ~np.r_[new[1:], True])
    group = group[tied]
    for at in range(8, text.depth, 8):
        if not len(tied):
            break
        own = order[tied]
        value = text.key[np.minimum(places[own] + at, n)]
        again = np.lexsort((value, group))
        own, value, group = own[again], value[again], group[again]
        order[tied] = own
        new = np.r_[True, (value[1:] != value[:-1]) | (group[1:] != group[:-1])]
        left = ~new | ~np.r_[new[1:], True]
        tied, group = tied[left], np.cumsum(new)[left]
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the array but the first: length of the prefix shared with the place before, `most` at most."""
    return _common_prefixes(Sorted.of(data, most), order)


def _common_prefixes(text: Sorted, order: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Neighbours of one hash are compared as a whole, all others eight bytes at a time."""
    shared = np.zeros(max(0, len(order) - 1), np.int64)
    n, most = len(text.data), text.depth
    alike = np.flatnonzero(text.digest[order[1:]] == text.digest[order[:-1]])
    windows = np.lib.stride_tricks.sliding_window_view(text.padded, most)
    for at in range(0, len(alike), chunk):
        part = alike[at : at + chunk]
        shared[part[(windows[order[part]] == windows[order[part + 1]]).all(axis=1)]] = most
    left = np.flatnonzero(shared < most)
    for at in range(0, most, 8):
        a, b = order[:-1][left] + at, order[1:][left] + at
        differ = text.key[np.minimum(a, n)] ^ text.key[np.minimum(b, n)]
        same = differ == 0
        shared[left[same]] = at + 8
        rest = differ[~same]
        bits = np.zeros(len(rest), np.int64)  # equal leading bytes
        for i in range(1, 8):
            bits += (rest >> np.uint64(64 - 8 * i)) == 0
        shared[left[~same]] = at + bits
        left = left[same]
        if not len(left):
            break
    return np.minimum(shared, most)


def repeated_starts(contexts: list[bytes], weights: np.ndarray, window: int = WINDOW, short: int = SHORT) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context: where its strings of `window` bytes start, and those of `short`, that occur twice, counted by
    weight, among all contexts. Of the latter, those that start behind the last window are looked at where their first
    bytes say so, at one place in eight."""
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(contexts)), lengths)
    left = lengths[owner] - (np.arange(len(data)) - begin[owner])  # bytes to the end of the context
    text = Sorted.of(data, window)
    with np.errstate(over="ignore"):
        picked = (text.key[: len(data)] * np.uint64(_ODD)) >> np.uint64(61) == 0  # the same places in equal strings
    order = _suffix_array(text, (left >= window) | ((left >= short) & picked))
    shared = _common_prefixes(text, order)
    found = []
    for width in (window, short):
        whole = left >= width
        group = np.cumsum(np.r_[True, shared < width][: len(order)]) - 1
        count = np.bincount(group, np.where(whole[order], weights[owner[order]], 0))
        hit = np.zeros(len(data), bool)
        hit[order] = count[group] >= 2
        hit &= whole
        found.append([np.flatnonzero(hit[b : b + n]) for b, n in zip(begin.tolist(), lengths.tolist())])
    return list(zip(*found))


def _spans(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes, from ascending window starts: begins and ends."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + window])
    return starts[new], np.r_[starts[new[1:] - 1], starts[-1]] + window


#: What is found in a context: spans of windows and of short strings that repeat.
_FOUND = ("begins", "ends", "short_begins", "short_ends")
_FOUND_TYPES = ", ".join(f"{n} array<int>" for n in _FOUND)


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, short: int = SHORT, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """What is cut out of each document: doc_id, n_bytes, n_repeated (bytes in repeated strings of `short` bytes, as far as
    they are found), n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    docs: doc_id, text. Null text counts as empty. A text shorter than the window stays whole. Rows that repeat a text are
    different places, so all of such a text of at least `window` bytes goes. Null and repeated doc_ids are documents
    like any others. Texts count whole, however long: their anchors are found piece by piece. Columns other than doc_id and
    text are not read, whatever their names. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    short = min(short, window)
    texts = numbered(docs, "texts")
    # Of equal texts, one stands for all, with their number; all that is long enough in them repeats.
    shas = written(texts.select("rid", F.unhex(F.sha2("text", 256)).alias("sha")), "text-digests")
    same = written(shas.groupBy("sha").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeated-texts")
    same = written(shas.join(same, "sha").select("rid", F.when(F.col("rid") == F.col("first"), F.col("copies")).alias("copies")), "equal-texts")
    different = texts.join(same.withColumn("equal", F.lit(True)), "rid", "left").filter("equal is null or copies is not null")
    marks = written(_anchor_rows(different.select("rid", F.coalesce("copies", F.lit(1)).alias("copies"), "text"), window, gram), "anchors")
    held = marks.groupBy("anchor", "one").agg(F.sum("copies").alias("weight"), F.min(F.struct("rid", "low", "high")).alias("place"))
    held = written(held, "contexts-by-anchor")
    busy = held.groupBy("anchor").agg(F.sum("weight").alias("times"), F.count(F.lit(1)).alias("kinds")).filter("times > 1")
    chosen = written(held.join(busy, "anchor").select("anchor", "one", "weight", "place.*", (F.col("kinds") > hot).alias("hot")), "repeated-anchors")
    hits = written(_sorted_hits(_contexts(texts, chosen.filter("not hot"), window, gram), window, short, block), "repeated-windows")
    crowded = chosen.filter("hot")
    if not crowded.isEmpty():
        contexts = written(_contexts(texts, crowded, window, gram, placed=True), "contexts-of-hot-anchors")
        hits = hits.unionByName(_split_hits(contexts, window - gram + 1, window, short, block, hot))
    # What holds for one context holds for all equal ones.
    places = marks.filter("copies = 1").join(hits, ["anchor", "one"]).groupBy("rid").agg(F.collect_list(F.struct("low", *_FOUND)).alias("places"))
    found = places.unionByName(same.select("rid", F.lit(True).alias("equal")), allowMissingColumns=True)
    return _cut(texts.join(found, "rid", "left").select("doc_id", "text", "places", "equal"), window, short)


def _batches(rows: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held, n = [], 0
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _anchor_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each anchor of texts (rid, copies, text): rid, copies, anchor, one (digest of the context), low, high."""
    names = ["rid", "copies", "anchor", "one", "low", "high"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(_ODD)
        for batch in batches:
            for rid, copies, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                anchor, one, low, high = anchors(np.frombuffer(text.as_buffer(), np.uint8), hasher, window, gram)
                if len(anchor):
                    columns = (np.full(len(anchor), rid), np.full(len(anchor), copies), anchor.view(np.int64), one.view(np.int64), low.astype(np.int32), high.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "rid bigint, copies bigint, anchor bigint, one bigint, low int, high int"
    return texts.mapInArrow(lambda batches: given_back(_batches(find(batches))), schema)


def _contexts(texts: DataFrame, chosen: DataFrame, window: int, gram: int, placed: bool = False) -> DataFrame:
    """anchor, one, weight, at and context of each chosen one (rid, anchor, one, weight, low, high). With placed, at is the
    anchor's place in the context."""
    wanted = chosen.groupBy("rid").agg(F.collect_list(F.struct("anchor", "one", "weight", "low", "high")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(_ODD)
        for batch in batches:
            owner, items = flattened(batch.column(1))
            anchor, one, weight, low, high = (pc.struct_field(items, i) for i in range(5))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            lows, highs = low.to_numpy(), high.to_numpy()
            for i, text in enumerate(batch.column(0)):
                a, b = bounds[i], bounds[i + 1]
                raw = text.as_buffer().to_pybytes()
                own = [raw[x : y + window] for x, y in zip(lows[a:b].tolist(), highs[a:b].tolist())]
                at = [_anchor_place(np.frombuffer(c, np.uint8), hasher, window, gram) if placed else 0 for c in own]
                columns = [anchor.slice(a, b - a), one.slice(a, b - a), weight.slice(a, b - a), pa.array(at, pa.int32()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "one", "weight", "at", "context"])

    joined = texts.join(wanted, "rid").select("text", "wanted")
    return joined.mapInArrow(lambda batches: given_back(_batches(fetch(batches), 5_000)), "anchor bigint, one bigint, weight bigint, at int, context binary")


def _anchor_place(context: np.ndarray, hasher: _Hasher, window: int, gram: int) -> int:
    m = window - gram + 1
    hashes = hasher.spans(hasher.prefix(context[:window]), slice(0, m), slice(gram, gram + m), slice(0, m))
    return int(_smallest(hashes, m)[0])


def _sorted_hits(contexts: DataFrame, window: int, short: int, block: int) -> DataFrame:
    """For each context of contexts (anchor, one, weight, context) in which something repeats: anchor, one and _FOUND."""
    dealt = contexts.select("anchor", "one", "weight", "context").repartition("anchor").sortWithinPartitions("anchor")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, block):
            found = repeated_starts(table["context"].to_pylist(), table["weight"].to_numpy(), window, short)
            some = np.array([len(x) + len(y) > 0 for x, y in found])
            spans = [(*_spans(x, window), *_spans(y, short)) for x, y in found if len(x) + len(y)]
            kept = table.select(["anchor", "one"]).filter(pa.array(some, pa.bool_()))
            for i, name in enumerate(_FOUND):
                kept = kept.append_column(name, pa.array([x[i].tolist() for x in spans], pa.list_(pa.int32())))
            yield from kept.combine_chunks().to_batches()

    return dealt.mapInArrow(lambda batches: given_back(search(batches)), f"anchor bigint, one bigint, {_FOUND_TYPES}")


def _split_hits(contexts: DataFrame, width: int, window: int, short: int, block: int, hot: int) -> DataFrame:
    """As _sorted_hits, for contexts (anchor, one, weight, at, context) of keys that too many share: all are given longer
    keys, and keys that too many share even so are split again.

    width: windows of a key have their anchor at one of so many places; after the last split, at one.
    """
    width = -(-width // FINER)
    parts = written(contexts.mapInArrow(functools.partial(_finer, width=width, window=window), "anchor bigint, one bigint, weight bigint, key bigint, part bigint, at int, shift int, context binary"), "split-contexts")
    different = parts.groupBy("key", "part").agg(F.sum("weight").alias("weight"), F.any_value("at").alias("at"), F.any_value("context").alias("context"))
    different = written(different.select(F.col("key").alias("anchor"), F.col("part").alias("one"), "weight", "at", "context"), "different-parts")
    busy = different.groupBy("anchor").agg(F.sum("weight").alias("times"), F.count(F.lit(1)).alias("kinds")).filter("times > 1")
    busy = written(busy.select("anchor", (F.col("kinds") > hot).alias("hot")), "repeated-keys")
    busy = busy.withColumn("hot", F.col("hot") & F.lit(width > 1))
    cool = different.join(busy.filter("not hot").select("anchor"), "anchor", "left_semi")
    hits = written(_sorted_hits(cool, window, short, block), "repeated-windows-of-parts")
    crowded = busy.filter("hot").select("anchor")
    if not crowded.isEmpty():
        hits = hits.unionByName(_split_hits(written(different.join(crowded, "anchor", "left_semi"), "hot-parts"), width, window, short, block, hot))
    named = hits.select(F.col("anchor").alias("key"), F.col("one").alias("part"), *_FOUND)
    back = parts.select("anchor", "one", "key", "part", "shift").join(named, ["key", "part"])
    moved = [F.flatten(F.collect_list(F.transform(n, lambda x: x + F.col("shift")))).alias(n) for n in _FOUND]
    return written(back.groupBy("anchor", "one").agg(*moved), "repeated-windows-of-split-anchors")


def _finer(batches: Iterator[pa.RecordBatch], width: int, window: int) -> Iterator[pa.RecordBatch]:
    """The parts of each context by ranges of `width` places of the anchor in a window: key is a hash of the range and of the
    bytes that all windows of the range share, part a digest of what the context has of it, shift where in the context that
    begins."""
    hasher = _Hasher(_ODD_2)

    def parts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(4)):
                raw = raw.as_buffer().to_pybytes()
                place, last = batch.column(3)[i].as_py(), len(raw) - window
                ranges = np.arange(max(0, place - last) // width, place // width + 1)
                low = np.maximum(0, place - (ranges + 1) * width + 1)
                high = np.minimum(last, place - ranges * width)
                prefix = hasher.prefix(np.frombuffer(raw, np.uint8))
                begin, end = place - ranges * width, place - (ranges + 1) * width + 1 + window
                with np.errstate(over="ignore"):
                    own = np.uint64(batch.column(0)[i].as_py() & (1 << 64) - 1) * np.uint64(_ODD) + ranges.astype(np.uint64) * np.uint64(2 * width + 1)
                    key = hasher.spans(prefix, begin, end, begin) ^ (own * np.uint64(_ODD))
                part = _digests(np.frombuffer(raw, np.uint8), np.full(len(low), place), low, high, window)
                same = [pa.array(np.full(len(low), batch.column(c)[i].as_py())) for c in range(3)]
                cut = pa.array([raw[a : b + window] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
                columns = [*same, pa.array(key.view(np.int64)), pa.array(part.view(np.int64)), pa.array((place - low).astype(np.int32)), pa.array(low.astype(np.int32)), cut]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "one", "weight", "key", "part", "at", "shift", "context"])

    return given_back(_batches(parts(), 5_000))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Whole groups of one anchor, packed to about `block` bytes of contexts."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows and pc.sum(pc.binary_length(held["context"])).as_py() >= block:
            anchor = held["anchor"].to_numpy()
            new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            size = np.cumsum(pc.binary_length(held["context"]).to_numpy())
            at = 0
            while True:
                after = new[(new > at) & (size[new - 1] - (size[at - 1] if at else 0) >= block)]
                if not len(after):
                    break
                yield held.slice(at, int(after[0]) - at)
                at = int(after[0])
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


def _cut(rows: DataFrame, window: int, short: int) -> DataFrame:
    """Every text (doc_id, text, places, equal) without its repeated spans."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Cuts(batch.column(0).type, ["n_repeated"])
            owner, items = flattened(batch.column(2))
            low = pc.struct_field(items, 0).to_numpy().astype(np.int64)
            spans = []
            for i in (1, 3):
                of, begin = flattened(pc.struct_field(items, i))
                end = pc.list_flatten(pc.struct_field(items, i + 1))
                spans.append(merged(owner[of], low[of] + begin.to_numpy(), low[of] + end.to_numpy()))
            long, repeated = spans
            bounds = np.searchsorted(long[0], np.arange(batch.num_rows + 1)).tolist()
            covered = np.bincount(repeated[0], repeated[2] - repeated[1], batch.num_rows).astype(np.int64).tolist()
            for i, (doc_id, text, equal) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist())):
                raw, (a, b) = text.as_buffer().to_pybytes(), bounds[i : i + 2]
                begin, end = long[1][a:b].tolist(), long[2][a:b].tolist()
                if equal and len(raw) >= window:
                    begin, end = [0], [len(raw)]
                full = out.add(doc_id, raw, (len(raw) if equal and len(raw) >= short else covered[i],), begin, end)
                if full is not None:
                    yield full
            rest = out.flush()
            if rest is not None:
                yield rest

    return rows.mapInArrow(lambda batches: given_back(cut(batches)), Cuts(pa.int64(), ["n_repeated"]).schema(id_type))
