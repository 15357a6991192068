"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: h = 2 h + GEAR[byte]. A chunk ends where some bits of h are zero. Those bits
see the last WINDOW bytes only, so an insertion moves the cuts near it and no others. Chunks are compared by a 128-bit
digest; the first occurrence of each stays, and later ones are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .memory import given_back
from .store import written
from .texts import Cuts, flattened, merged, numbered

#: A random number for each byte, drawn from a digest of the byte.
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4")
WINDOW = 16
#: Bits 11 to 15 of the hash hang on the last 12 to 16 bytes.
MASK = np.uint32(0b11111 << 11)
LEAST, MOST = 32, 512
#: Above any place in a text.
_FAR = 1 << 40
#: Runs of repeated chunks of fewer bytes stay, unless they are all of their text: short ones are common wording.
RUN = 64


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte, as far as it hangs on the last WINDOW bytes, by doubling the bytes that count."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def cuts(data: np.ndarray, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks: each has at least `least` bytes, but for the last, and at most `most`."""
    ends, last, n = [], 0, len(data)
    for c in (np.flatnonzero((gear_hashes(data) & MASK) == 0) + 1).tolist():
        while c - last > most:
            last += most
            ends.append(last)
        if c - last >= least:
            last = c
            ends.append(c)
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunk_rows(texts: DataFrame, least: int, most: int) -> DataFrame:
    """rid, doc_id, begin, size and the digest (one, two) of every chunk."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    names = ["rid", "doc_id", "begin", "size", "one", "two"]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
        for batch in batches:
            held: list[tuple] = []
            rows, begins, sizes, digests = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                ends = cuts(np.frombuffer(raw, np.uint8), least, most)
                starts = [0, *ends[:-1]] if ends else []
                rows.append(np.full(len(ends), i))
                begins += starts
                sizes += [b - a for a, b in zip(starts, ends)]
                digests += [digest(raw[a:b]) for a, b in zip(starts, ends)]
                if len(digests) > 50_000 or i + 1 == batch.num_rows:
                    held.append((np.concatenate(rows), begins, sizes, digests))
                    rows, begins, sizes, digests = [], [], [], []
                    for at, a, n, d in held:
                        sums = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
                        where = pa.array(at)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names)
                    held = []

    return texts.mapInArrow(lambda batches: given_back(chunk(batches)), f"rid bigint, doc_id {id_type}, begin bigint, size bigint, one bigint, two bigint")


def repeats(docs: DataFrame, least: int = LEAST, most: int = MOST, run: int = RUN) -> DataFrame:
    """What chunks each document shares: doc_id, n_bytes, n_chunks, n_shared (bytes of chunks that occur elsewhere too, the
    first occurrence included), n_removed (bytes cut out), n_spans (maximal runs cut out), kept_sha256, kept.

    docs: doc_id, text. The first occurrence is that of the smallest doc_id (null first), then of the smallest row and
    place. Shared chunks count only in runs of at least `run` bytes or of the whole text. Null text counts as empty and has no chunk; rows
    that repeat a text are different documents, of which one stays whole. Texts are cut whole, however long. Columns other than
    doc_id and text are not read, whatever their names. An empty table gives no rows.

    A chunk that very many documents share is combined before the shuffle, and its rows are split by the join.
    """
    ship(docs.sparkSession)
    texts = numbered(docs, "chunk-texts")
    chunks = written(_chunk_rows(texts, least, most), "chunks")
    first = F.min(F.struct("doc_id", "rid", "begin")).alias("first")
    groups = chunks.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").select("one", "two", F.col("first.rid").alias("first_rid"), F.col("first.begin").alias("first_begin"))
    groups = written(groups, "repeated-chunks")
    later = (F.col("rid") != F.col("first_rid")) | (F.col("begin") != F.col("first_begin"))
    found = chunks.join(groups, ["one", "two"]).select("rid", F.struct("begin", (F.col("begin") + F.col("size")).alias("end"), later.alias("later")).alias("chunk"))
    found = found.groupBy("rid").agg(F.collect_list("chunk").alias("chunks"))
    return _cut(texts.join(found, "rid", "left").select("doc_id", "text", "chunks"), least, most, run)


def _cut(rows: DataFrame, least: int, most: int, run: int) -> DataFrame:
    """Every text (doc_id, text, chunks: what of it is shared) without later occurrences."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = ["n_chunks", "n_shared"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Cuts(batch.column(0).type, counts)
            raws = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            size = np.fromiter(map(len, raws), np.int64, len(raws))
            owner, items = flattened(batch.column(2))
            begin, end, later = (pc.struct_field(items, i).to_numpy(zero_copy_only=False) for i in range(3))
            of, x, y = merged(owner, begin, end)
            long = (y - x >= run) | (y - x == size[of])
            of, x, y = of[long], x[long], y[long]
            shared = np.bincount(of, y - x, len(raws)).astype(np.int64).tolist()
            # Later occurrences go where they lie in such a run.
            at = np.searchsorted(of * _FAR + x, owner * _FAR + begin, side="right") - 1
            inside = (at >= 0) & (of[at] == owner) & (begin < y[at]) if len(of) else np.zeros(len(owner), bool)
            gone = inside & later.astype(bool)
            of, x, y = merged(owner[gone], begin[gone], end[gone])
            bounds = np.searchsorted(of, np.arange(len(raws) + 1)).tolist()
            for i, (doc_id, raw) in enumerate(zip(batch.column(0).to_pylist(), raws)):
                a, b = bounds[i : i + 2]
                n_chunks = len(cuts(np.frombuffer(raw, np.uint8), least, most))
                full = out.add(doc_id, raw, (n_chunks, shared[i]), x[a:b].tolist(), y[a:b].tolist())
                if full is not None:
                    yield full
            rest = out.flush()
            if rest is not None:
                yield rest

    return rows.mapInArrow(lambda batches: given_back(cut(batches)), Cuts(pa.int64(), counts).schema(id_type))
