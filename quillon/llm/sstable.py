"""Token ids in sorted-string-table shards.

A shard holds entries in ascending key order:

    data blocks | index | Bloom filter | footer

- A key is one byte 0 for a null identifier, or one byte 1 and the identifier as 8 big-endian bytes with the sign bit
  flipped, so that the order of keys as bytes is null first, then ascending numbers.
- A block holds entries until it reaches `block_bytes`. An entry is (shared, rest, size) as variable-length integers,
  the last `rest` bytes of the key (its first `shared` bytes are those of the key before, 0 at the start of a block),
  and `size` bytes of value. A value is one byte, 2 or 4, and the ids as little-endian integers of that width.
- The index has, for each block, the key of its first entry, its offset and its length.
- The Bloom filter has `bits` bits; a key sets `hashes` of them.
- The footer has fixed length: offsets and lengths of index and filter, entries, token count, number of the shard in the
  order of keys, hashes, crc32 of index and filter, and a closing mark.

A lookup reads the footer, asks the filter, finds the block by binary search in the index, and decodes that block alone.

Shards are written and read by Spark itself, so they may lie in any storage that it knows, and a task that runs twice
leaves one file: a shard is one line of a text file, and the line end that the writer adds is the last byte of the mark.
"""

from __future__ import annotations

import bisect
import io
import os
import struct
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import store
from .memory import given_back
from .pretokens import Memory, cut, spread
from .words import slices, texts_of

MARK = b"QSST002\n"
FOOTER = struct.Struct("<QQQQQQQIII8s")
_PAIR = struct.Struct("<QI")


def key_of(identifier: int | None) -> bytes:
    return b"\x00" if identifier is None else b"\x01" + struct.pack(">Q", identifier + (1 << 63))


def identifier_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    """Two independent 32-bit sums stand for any number of hashes."""
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes one shard; keys must come in ascending order, equal ones may follow each other."""

    def __init__(self, sink, number: int = 0, block_bytes: int = 64 << 10, bits_per_key: int = 10, hashes: int = 7):
        self.sink, self.number, self.block_bytes, self.bits_per_key, self.hashes = sink, number, block_bytes, bits_per_key, hashes
        self.block, self.first, self.last = bytearray(), b"", None
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.offset = self.tokens = 0

    def add(self, identifier: int | None, ids: np.ndarray) -> None:
        key = key_of(identifier)
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        value = ids.astype(f"<u{width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value) + 1) + key[shared:] + bytes([width])
        self.block += value
        self.keys.append(key)
        self.last, self.tokens = key, self.tokens + len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.offset, len(self.block)))
            self.sink.write(bytes(self.block))
            self.offset += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _PAIR.pack(o, n) for k, o, n in self.index)
        bits = max(64, self.bits_per_key * len(self.keys))
        bloom = np.zeros(-(-bits // 8) * 8, np.uint8)
        bloom[[p for k in self.keys for p in _bloom_places(k, bits, self.hashes)]] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.sink.write(index)
        self.sink.write(packed)
        self.sink.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), bits, len(self.keys), self.tokens, self.number, self.hashes, zlib.crc32(index), zlib.crc32(packed), MARK))


class Reader:
    """Reads one shard from a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(max(0, size - FOOTER.size))
        footer = source.read(FOOTER.size)
        if len(footer) < FOOTER.size:
            raise ValueError("not a shard of this format, or cut short")
        at, length, filter_at, self.bits, self.entries, self.tokens, self.number, self.hashes, crc, filter_crc, mark = FOOTER.unpack(footer)
        if mark != MARK:
            raise ValueError("not a shard of this format, or cut short")
        source.seek(at)
        index = source.read(length)
        self.bloom = source.read(size - FOOTER.size - filter_at)
        if zlib.crc32(index) != crc or zlib.crc32(self.bloom) != filter_crc:
            raise ValueError("a shard is damaged")
        self.first_keys, self.blocks, i = [], [], 0
        while i < length:
            n, i = _read_varint(index, i)
            self.first_keys.append(index[i : i + n])
            self.blocks.append(_PAIR.unpack_from(index, i + n))
            i += n + _PAIR.size

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.blocks[block]
        self.source.seek(offset)
        data, at, key = self.source.read(length), 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{data[at]}", (size - 1) // data[at], at + 1)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, ids in self._entries(block):
                yield identifier_of(key), ids

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every entry of that identifier, in their order; none if it is absent."""
        key = key_of(identifier)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits, self.hashes)):
            return []
        found = []
        block = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while block < len(self.blocks) and self.first_keys[block] <= key:
            found += [ids for k, ids in self._entries(block) if k == key]
            block += 1
        return found


class LibraryEncoder:
    """Encodes with the tokenizers library, asking it once for each piece of text that repeats.

    The pieces are joined by the tokenizer's own end mark, which splits them again inside the library: what it returns
    is cut at that mark's id. Texts that spell the mark go to the library as they are, which reads it as that id.
    """

    def __init__(self, path: str, end_mark: str = "<|endoftext|>", chunk: int = 16384):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.chunk = Tokenizer.from_file(path), chunk
        self.memory = Memory(self._learn)
        self.mark, self.mark_id = end_mark, self.library.token_to_id(end_mark)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, flat = [], []
        for a in range(0, len(pieces), self.chunk):
            ids = np.array(self.library.encode_batch_fast([self.mark.join(pieces[a : a + self.chunk])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            lengths.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[ids != self.mark_id])
        return (np.concatenate(lengths), np.concatenate(flat)) if lengths else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        marked = pc.match_substring(texts, self.mark)
        pieces = cut(pc.if_else(marked, pa.scalar("", texts.type), texts))
        ids, starts = spread(pieces, *self.memory.ids(pieces.unique))
        rows = [ids[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist())]
        for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            rows[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return rows


_ENCODERS: dict[str, LibraryEncoder] = {}
_LOCK = threading.Lock()


def _encoder(path: str) -> LibraryEncoder:
    with _LOCK:
        if path not in _ENCODERS:
            _ENCODERS[path] = LibraryEncoder(path)
        return _ENCODERS[path]


def write_shards(docs: DataFrame, target: str, tokenizer: str, end_id: int = 0, shards: int | None = None, shard_bytes: int = 32 << 20, most_bytes: int = 3 << 20) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes shards in ascending doc_id order to the folder target.

    A task holds one shard at a time and begins the next one when that has shard_bytes.

    Null text counts as empty: the end id alone. A null doc_id comes first. Rows that repeat a doc_id stand next to each
    other, ordered by a hash of their texts, and may fill several shards. A text is encoded whole, however long, and is one entry, so a
    shard may grow past shard_bytes by one. Other columns are not read, whatever their names. doc_ids are whole numbers of 64
    bits. An empty table gives no shards.
    """
    ship(docs.sparkSession)
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = (F.asc_nulls_first("doc_id"), F.asc("h"))
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number, writer = _encoder(tokenizer), TaskContext.get().partitionId() << 24, None

        def ended() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([writer.sink.getvalue()[:-1]], pa.binary())], ["shard"])

        for batch in batches:
            texts, ids_of = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in slices(texts, most_bytes):
                for identifier, ids in zip(ids_of[a:b], encoder.batch(texts.slice(a, b - a))):
                    if writer is None:
                        writer = Writer(io.BytesIO(), number)
                    writer.add(identifier, np.append(ids, np.uint32(end_id)))
                    if writer.offset >= shard_bytes:
                        yield ended()
                        writer, number = None, number + 1
        if writer is not None:
            yield ended()

    # Bytes stay bytes in this cast and in the file; every line has a file of its own.
    lines = ordered.mapInArrow(lambda batches: given_back(write(batches)), "shard binary").select(F.col("shard").cast("string"))
    # Whatever the cluster compresses, shards are read as they are.
    lines.write.option("maxRecordsPerFile", 1).option("compression", "none").text(target)


def _files(spark: SparkSession, target: str) -> DataFrame:
    """content of each shard."""
    ship(spark)
    return spark.read.format("binaryFile").load(target).filter("length > 0").select("content")


def shard_list(spark: SparkSession, target: str) -> DataFrame:
    """shard (its number), entries, tokens and base (tokens of all shards before) of each shard. One row per file is summed up."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                r = Reader(io.BytesIO(content.as_buffer()))
                yield pa.RecordBatch.from_pydict({"shard": [r.number], "entries": [r.entries], "tokens": [r.tokens]})

    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    found = _files(spark, target).mapInArrow(footers, "shard bigint, entries bigint, tokens bigint")
    return store.written(found.withColumn("base", F.coalesce(before, F.lit(0))), "shard-list")


def read_shards(spark: SparkSession, target: str) -> DataFrame:
    """Every entry of the shards in target: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held, at = [], 0, 0
                reader = Reader(io.BytesIO(content.as_buffer()))
                for identifier, ids in reader:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((identifier, reader.number, at, len(ids), zlib.crc32(raw), raw))
                    at += len(ids)
                    held += len(raw)
                    if held > 1 << 22:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    entries = _files(spark, target).mapInArrow(lambda batches: given_back(read(batches)), "doc_id bigint, shard bigint, place bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    start = (F.col("base") + F.col("place")).alias("start")
    return entries.join(shard_list(spark, target).select("shard", "base"), "shard").select("doc_id", start, "n_tokens", "ids_crc32", "ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (*[pa.int64()] * 5, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "shard", "place", "n_tokens", "ids_crc32", "ids"])


def lookup(spark: SparkSession, target: str, doc_id: int | None) -> list[list[int]]:
    """The ids stored under doc_id, by filter and binary search; the shards are asked on the executors."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = Reader(io.BytesIO(content.as_buffer())).get(doc_id)
                if found:
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([x.astype(np.int64).tolist() for x in found], pa.list_(pa.int64()))})

    return [r["ids"] for r in _files(spark, target).mapInArrow(ask, "ids array<bigint>").collect()]
