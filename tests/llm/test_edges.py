"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, chunk_dedup, exact_dedup, knn, mixing, pretokens, quality, shingle_sets, simhash, sstable, store, suffix_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN, LIBRARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, fp string, size string, keep_id string, row string, weight_ string"
LONG = " ".join(f"word{i % 997} x{i}" for i in range(40_000))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "d", "f", "s", "k", "r", "w") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        (1, "The cat sat on the mat today", "a"), (2, "the CAT sat on the mat today", "a"), (3, None, None), (4, "", "b"), (5, LONG, "a"),
        (6, LONG + " tail", "b"), (7, "Ünï CÖDE", "b"), (8, "ünï cÖDE", "b"), (2, "the CAT sat on the mat today", "a"), (2, "the CAT sat on the mat today", "a"),
        (None, "no number", "a"), (9, " \t\n ", None), (10, "  odd  spaces\r\n\r\nhere <|endoftext|> ok", "b"), (11, "x", "a"), (12, "\x00nul\x00", "a"),
    ]
    return store.written(frame(spark, texts), "edge-docs")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_exact_dedup(docs, nothing):
    rows = docs.collect()
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for r in rows:
        k = norm(r.text)
        n, top = best.get(k, (0, None))
        best[k] = (n + 1, r.doc_id if top is None or (r.doc_id is not None and r.doc_id > top) else top)
    for digest in (exact_dedup.sha256_hex, lambda t: F.substring(F.sha2(t, 256), 1, 1), lambda t: F.lit("same")):
        got = exact_dedup.exact_groups(docs, digest).collect()
        expected = sorted((str(r.doc_id), best[norm(r.text)][0], str(best[norm(r.text)][1])) for r in rows)
        assert sorted((str(r.doc_id), r.group_size, str(r.keep_id)) for r in got) == expected
        assert sum(r.kept for r in got) == len(best)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        kept = exact_dedup.deduplicated(docs, digest)
        assert kept.columns == docs.columns
        assert sorted(norm(r.text) for r in kept.collect()) == sorted(best)
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.deduplicated(nothing).count() == 0


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Smallest place reachable, by comparing all pairs."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_simhash(docs, nothing):
    rows = [r for r in docs.collect()]
    prints = [fingerprint(r.text) for r in rows]
    root = components(prints)
    least = {}
    for r, c in zip(rows, root):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), format(p, "016x"), str(least.get(c))) for r, p, c in zip(rows, prints, root))
    got = simhash.near_groups(docs).withColumn("h", simhash.fingerprint_hex(F.col("fp"))).collect()
    assert sorted((str(r.doc_id), r.h, str(r.component_id)) for r in got) == expected
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.near_groups(nothing).count() == 0 and simhash.deduplicated(nothing).count() == 0


def test_simhash_keeps_every_component(spark):
    """Components without a doc_id, and different texts under one doc_id, are components of their own."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(None, text(i), "a") for i in range(6)] + [(7, text(i), "a") for i in range(6, 12)] + [(8, text(11), "a"), (None, text(11), "b"), (None, text(0), "b"), (9, text(12), "a")]
    kept = simhash.deduplicated(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", text(i)) for i in range(6)] + [("7", text(i)) for i in range(6, 12)] + [("9", text(12))])


def five_words(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_stage_links_all_similar_pairs(spark, docs, nothing):
    """Edited copies of random texts, against all pairs; the stage keeps one row of each component."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(8, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.integers(1, 14)):
            copy = list(base)
            for _ in range(rng.integers(1, max(2, len(base) // 20))):
                copy[rng.integers(len(copy))] = f"e{rng.integers(9999)}"
            texts.append(" ".join(copy))
    sets = [five_words(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if root[j] < root[i] and 5 * len(x & y) >= 4 * len(x | y):
                    root[i], changed = root[j], True
    order = rng.permutation(len(texts)).tolist()
    table = frame(spark, [(i, texts[i], "s") for i in order]).repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, table, "")
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and len(set(root)) > 12
    some = docs.collect()
    left = sorted((str(r.doc_id), r.text) for r in shingle_sets.deduplicated(docs).collect())
    assert [i for i, _ in left] == sorted(["1", "3", "5", "7", "8", "10", "11", "12", "None"]) and len(some) == 15
    assert shingle_sets.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 8, 1])
def test_simhash_dense_group(spark, hot):
    """Values around a few centres, with many links in a bucket; the way for hot keys gives the same components."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    n = 250 if hot == simhash.HOT else 60
    values = {int(c) for c in centres}
    for c in centres[:3]:
        for _ in range(n // 3):
            x = int(c)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    edges = simhash.links(nodes, hot)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4 for r in edges.collect())
    from quillon.llm.components import components as joined

    found = {r.node: r.root for r in joined(edges).collect()}
    groups, expected = {}, {}
    for s, c in zip(signed, components(values)):
        groups.setdefault(found.get(s, s), set()).add(s)
        expected.setdefault(c, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_hot_key_of_simhash(spark):
    """30,000 fingerprints of one key, most of them far apart: the key grows longer and the planted pairs are linked."""
    rng = np.random.default_rng(21)
    values = set((rng.integers(0, 1 << 45, 30_000, dtype=np.uint64) << np.uint64(19) | np.uint64(0b1010101)).tolist())
    pairs = []
    for v in sorted(values)[:40]:
        w = v
        for bit in rng.choice(np.arange(19, 64), 4, replace=False):
            w ^= 1 << int(bit)
        pairs.append((v, w))
        values.add(w)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(nodes).collect()}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in found)
    from quillon.llm.components import components as joined

    root = {r.node: r.root for r in joined(spark.createDataFrame(sorted(found), "a bigint, b bigint")).collect()}
    for v, w in pairs:
        assert root.get(signed(v), signed(v)) == root.get(signed(w), signed(w))


def test_components_of_paths_and_loops(spark):
    from quillon.llm.components import components as joined

    edges = [(i, i + 1) for i in range(100, 160)] + [(3, 3), (7, 9), (9, 7), (7, 9), (8, 7)]
    got = {r.node: r.root for r in joined(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 9: 7, 8: 7}
    assert joined(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def removed(texts, window):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for i, b in enumerate(raws):
        for s in range(len(b) - window + 1):
            seen.setdefault(b[s : s + window], []).append((i, s))
    cover = [[False] * len(b) for b in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + window] = [True] * window
    return [(len(b), sum(c), sum(x and not y for x, y in zip(c, [False, *c])), hashlib.sha256(bytes(v for v, x in zip(b, c) if not x)).hexdigest()) for b, c in zip(raws, cover)]


def test_suffix_dedup(spark, docs, nothing):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcé "), rng.integers(1, 30)))
    passages = [word() * 3 for _ in range(6)]
    texts = [word() + passages[rng.integers(6)] + word() + passages[rng.integers(6)] for _ in range(60)] + ["a" * 90, "ab" * 40, "", None, texts_equal := "same text in two rows, long enough to count", texts_equal]
    frame_ = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(frame_, window=24, gram=8, block=500).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 24)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)  # how rows lie in files plays no part
    try:
        again = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(frame_, window=24, gram=8, block=500).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert again == got
    hot = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(frame_, window=24, gram=8, hot=1).collect()}
    assert hot == got
    rows = docs.filter("length(text) < 1000 or text is null").collect()
    some = frame(spark, [(r.doc_id, r.text, "s") for r in rows])
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(some, window=24, gram=8).collect())
    assert found == sorted((str(r.doc_id), *x) for r, x in zip(rows, removed([r.text for r in rows], 24)))
    both = {r.doc_id: r for r in suffix_dedup.removed(docs).collect()}
    assert both[5].n_removed == both[5].n_bytes == len(LONG) and both[6].n_removed == len(LONG)
    assert suffix_dedup.removed(nothing).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 120))
        data = rng.integers(0, int(rng.integers(1, 5)), n).astype(np.uint8)
        order, padded = suffix_dedup.suffix_array(data, 200), bytes(data) + bytes(300)
        assert sorted(order.tolist()) == list(range(n))
        keys = [padded[i : i + 200] for i in order]
        assert keys == sorted(keys)
        shared = suffix_dedup.common_prefixes(data, order, 40)
        for k in range(n - 1):
            x, y = keys[k][:40], keys[k + 1][:40]
            assert shared[k] == next((i for i in range(40) if x[i] != y[i]), 40)


def chunked(data, least, most):
    """Byte by byte."""
    ends, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        if i + 1 - last == most or (h & int(chunk_dedup.MASK) == 0 and i + 1 - last >= least):
            last = i + 1
            ends.append(last)
    return ends + ([len(data)] if last < len(data) else [])


def without_repeats(rows, run):
    """rows: (doc_id, text) in the order of doc_id, null first."""
    raws = [(t or "").encode() for _, t in rows]
    spans = [list(zip([0, *e[:-1]], e)) if (e := chunked(r, chunk_dedup.LEAST, chunk_dedup.MOST)) else [] for r in raws]
    places = {}
    for i, own in enumerate(spans):
        for a, b in own:
            places.setdefault(raws[i][a:b], []).append((i, a))
    out = []
    for i, own in enumerate(spans):
        shared, gone, at = [False] * len(raws[i]), [False] * len(raws[i]), 0
        while at < len(own):
            to = at
            while to < len(own) and len(places[raws[i][own[to][0] : own[to][1]]]) > 1:
                to += 1
            if to > at and (own[to - 1][1] - own[at][0] >= run or own[to - 1][1] - own[at][0] == len(raws[i])):
                for a, b in own[at:to]:
                    shared[a:b] = [True] * (b - a)
                    if places[raws[i][a:b]][0] != (i, a):
                        gone[a:b] = [True] * (b - a)
            at = max(to, at + 1)
        kept = bytes(v for v, g in zip(raws[i], gone) if not g)
        out.append((str(rows[i][0]), len(raws[i]), len(own), sum(shared), sum(gone), sum(x and not y for x, y in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest()))
    return out


def test_chunk_dedup(spark, docs, nothing):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(n))
    passage = word(60)
    texts = [word(40) + passage + word(30) if i % 3 == 0 else word(80) for i in range(40)] + ["", None, passage, passage, "short", "short", "z" * 3000]
    got = chunk_dedup.repeats(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    line = lambda r: (str(r.doc_id), r.n_bytes, r.n_chunks, r.n_shared, r.n_removed, r.n_spans, r.kept_sha256)
    assert sorted(map(line, got)) == sorted(without_repeats(list(enumerate(texts)), chunk_dedup.RUN))
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].n_shared > 100 for i in range(0, 40, 3)) and not any(by_id[i].n_shared for i in range(40) if i % 3)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(map(line, chunk_dedup.repeats(docs).collect())) == sorted(without_repeats(rows, chunk_dedup.RUN))
    assert chunk_dedup.repeats(nothing).count() == 0


def test_byte_bpe(docs, nothing):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = byte_bpe.encoded(docs, RANKS, PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.encoded(nothing, RANKS, PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)] + [b"", b"\x00", b"\x00\x00"]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.slot_index.tolist()) == list(range(len(keys)))
    assert table.find(keys).tolist() == list(range(len(keys)))
    assert set(table.find([b"other", b"\x00\x00\x00", b"k3000"]).tolist()) == {-1}
    assert byte_bpe.PerfectHash([]).find([b"a"]).tolist() == [-1]


def test_token_shards(spark, docs, nothing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(LIBRARY)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = docs.unionByName(frame(spark, [(20, "a <|endoftext|> b", "s"), (21, "<|endoftext|><|endoftext|>", "s"), (22, " a<|endoftext|>\n\n b", "s")]))
    target = store.fresh_path(spark, "t")
    sstable.write_shards(docs, target, LIBRARY, shards=3, shard_bytes=1 << 16)
    got = sorted(sstable.read_shards(spark, target).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert sstable.shard_list(spark, target).count() > 3
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at = 0
    for r, d in zip(got, rows):
        ids = plain.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(sstable.lookup(spark, target, 2)) == 3 and len(sstable.lookup(spark, target, None)) == 1
    assert sstable.lookup(spark, target, 4) == [[0]] and sstable.lookup(spark, target, 77) == []
    empty = store.fresh_path(spark, "t")
    sstable.write_shards(nothing, empty, LIBRARY)
    assert sstable.read_shards(spark, empty).count() == 0


def test_shard_format():
    sink = io.BytesIO()
    writer = sstable.Writer(sink, 7, block_bytes=64)
    keys = [None, -(1 << 63), -5, 0, 3, 3, 300, (1 << 63) - 1] + list(range(1 << 40, (1 << 40) + 200))
    order = sorted(keys, key=lambda k: (k is not None, k or 0))
    for i, k in enumerate(order):
        writer.add(k, np.arange(i % 40, dtype=np.uint32) + (1 << 16) * (i % 2))
    with pytest.raises(ValueError):
        writer.add(1, np.zeros(1, np.uint32))
    writer.close()
    reader = sstable.Reader(io.BytesIO(sink.getvalue()))
    assert len(reader.blocks) > 20 and reader.entries == len(order) and reader.number == 7
    assert [k for k, _ in reader] == order
    for i, k in enumerate(order):
        assert (np.arange(i % 40) + (1 << 16) * (i % 2)).tolist() in [x.tolist() for x in reader.get(k)]
    assert reader.get(4) == [] and reader.get(1 << 41) == [] and len(reader.get(3)) == 2
    for broken in (sink.getvalue()[:-1], b"", b"x" * 200):
        with pytest.raises(ValueError):
            sstable.Reader(io.BytesIO(broken))


def test_mixing(spark, docs, nothing):
    sized = mixing.sized(docs)
    sizes = {r.doc_id: r.size for r in sized.collect()}
    assert sizes[3] == sizes[4] == sizes[9] == 0 and sizes[1] == 7 and sizes[12] == 1
    got = mixing.mix(sized).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 2 for r in got)
    assert all(r.copies == 0 for r in got if r.size == 0)
    goal, taken = targets({s: sum(r.size for r in got if r.source == s) for s in {r.source for r in got}}), {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, g in goal.items():  # one document may be nearly all of its source
        assert abs(taken[s] - g) <= max(r.size for r in got if r.source == s) / 2 + 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(sized).collect()))
    assert mixing.mix(mixing.sized(nothing)).count() == 0
    copies = sum(r.copies for r in got)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert mixing.mixed_rows(nothing).count() == 0


def targets(sizes):
    """Deals by weight again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, goal, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            goal |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
        left -= sum(goal[s] for s in over)
        free -= over
    return goal


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_meets_targets(spark, weighted):
    rng = np.random.default_rng(2)
    rows = [(i, [None, "é", "Z", "a", "z", "hot", "hot", "hot"][rng.integers(8)], int(rng.integers(0, 900)), float(rng.integers(1, 6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, weight double")
    got = mixing.mix(df if weighted else df.drop("weight")).collect()
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, taken = targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * goal[r.source] + 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 0.02 * g + 900
    if weighted:
        mean = lambda w: np.mean([r.copies for r in got if r.size and rows[r.doc_id][3] == w])
        assert mean(1.0) < mean(3.0) <= mean(5.0)


def test_mix_takes_the_smallest_ranks(spark):
    """Expected copies, ranks and what is taken, against plain loops; only the random numbers come from the operator."""
    rng = np.random.default_rng(12)
    rows = [(i, "abc"[int(rng.integers(3))], int(rng.integers(0, 60)) ** 2) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    unit = {r.doc_id: r.u for r in df.select("doc_id", mixing._unit(7, F.col("doc_id"), F.col("size")).alias("u")).collect()}
    weight = {i: 2 ** (round(np.log2(np.log2(n + 1)) * 8) / 8) if n else 0.0 for i, _, n in rows}
    sizes = {s: sum(n for _, t, n in rows if t == s) for s in "abc"}
    for source, goal in targets(sizes).items():
        own = [(i, n) for i, s, n in rows if s == source and n]
        low, high = 0.0, 100.0
        for _ in range(200):  # the rate at which expected words meet the goal
            rate = (low + high) / 2
            low, high = (rate, high) if sum(n * min(2, rate * weight[i]) for i, n in own) < goal else (low, rate)
        expected = {i: min(2.0, rate * weight[i]) for i, _ in own}
        assert goal > 2 * sizes[source] - 1 or len({round(x, 6) for x in expected.values()}) > 5
        whole = {i: int(x + 1e-9) for i, x in expected.items()}
        p = {i: expected[i] - whole[i] for i, _ in own}
        rank = {i: unit[i] / (1 - unit[i]) / (p[i] / (1 - p[i])) for i in p if p[i] > 1e-6}
        size, left = dict(own), goal - sum(whole[i] * n for i, n in own)
        for i in sorted(rank, key=lambda i: (rank[i], i)):
            if size[i] > left:
                break
            left -= size[i]
            assert got[i].copies == whole[i] + 1  # all up to the place where the goal would be passed
        assert not rank or sum(got[i].copies for i in rank) < sum(whole[i] for i in rank) + len(rank)
        assert all(whole[i] <= got[i].copies <= whole[i] + 1 for i in expected)
        assert abs(sum(got[i].copies * n for i, n in own) - goal) < 60
    assert all(got[i].copies == 0 for i, _, n in rows if not n)


def best_five(rows):
    out = {}
    for i, v in rows:
        if v is not None and i is not None and i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if w is not None and j is not None and j != i)
            out[i] = [(j, -s) for s, j in scores[:5]]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.4, 8).tolist()) for i in range(160)] + [(i, [0.5] * 8) for i in range(160, 260)]
    rows += [(300, None), (350, [None] + [0.1] * 7), (301, [float("nan")] * 8), (302, [float("inf")] * 8), (None, [9.0] * 8), (400, [0.3] * 3)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, cell string, rank int")
    ints = [(i, None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    for options in ({}, {"n_pivots": 5, "block": 16}, {"n_pivots": 1, "block": 7}):
        got = {}
        for r in knn.top_k(knn.quantised(df), F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == best_five(ints)
    assert knn.top_k(knn.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    assert knn.top_k(knn.quantised(df.filter("vec_id in (0, 7)")), F.col("vec_id") % 50 == 0).count() == 1
    huge = spark.createDataFrame([(0, [2.0**60, 1.0]), (1, [2.0**60, 1.0]), (2, [-(2.0**60), 0.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in knn.top_k(knn.quantised(huge), F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_top_k_leaves_cells_out(spark):
    """On clustered vectors queries look into few cells, and find the same."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.05, 16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = store.written(knn.quantised(df), "clusters")
    found, asks, sizes = knn.search(vectors, F.col("vec_id") % 50 == 0, n_pivots=64, block=512)
    solved, n_queries = sum(sizes[r.cell] for r in asks.collect()), 120
    assert solved < 0.35 * n_queries * len(rows)
    v = np.array([np.floor(256 * np.array(x)) for _, x in rows]).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn._ranked(found, 5).collect()}
    for q in range(0, 6000, 50):
        score = v @ v[q]
        best = [j for j in np.lexsort((np.arange(6000), -score)) if j != q][:5]
        assert [got[q, i + 1] for i in range(5)] == [(j, score[j]) for j in best]


def test_classifiers_score_every_row(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 1), (7, 0, None), (2, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    for module, column, label in ((quality, "quality_score", "quality"), (toxicity, "toxic_score", "toxic")):
        model = module.train(docs, labels, label)
        got = module.scored(docs, model)
        assert got.count() == docs.count() and got.filter(f"{column} between 0 and 1").count() == docs.count()
        assert got.columns == [*docs.columns, column]
        assert module.scored(nothing, model).count() == 0
        constant = module.train(nothing, labels.limit(0), label)
        assert module.scored(docs, constant).filter(f"{column} between 0 and 1").count() == docs.count()
    kept = quality.accepted(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns


def test_memory_of_pieces():
    """What is given out is what learn gives, over generations, for pieces that come twice and for none."""
    asked = []

    def learn(pieces):
        asked.extend(pieces)
        return np.array([len(p) for p in pieces]), np.array([ord(c) for p in pieces for c in p], np.uint32)

    memory, rng = pretokens.Memory(learn, most=40, step=16), np.random.default_rng(0)
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 90, rng.integers(0, 30))] + ["", "é", "w1"]
        lengths, flat = memory.ids(pa.array(words, pa.large_string()).slice(0))
        assert lengths.tolist() == [len(w) for w in words] and flat.tolist() == [ord(c) for w in words for c in w]
    assert 92 <= len(asked) < 60 * 20 and asked.count("w1") == 1  # common pieces stay
    assert memory.ids(pa.array([], pa.large_string()))[0].tolist() == []


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
@pytest.mark.parametrize("letters", ["ab", "AB", "01", "aA", "éè"])
def test_pieces_that_arithmetic_hashes_confuse(n, letters):
    """A Thue-Morse word and its complement agree in polynomials modulo 2^64, whatever the odd base."""
    import tiktoken
    from tokenizers import Tokenizer

    words = ["".join(letters[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1)]
    texts = [*words, f"{words[1]} {words[0]}", " ".join(words)]
    column = pa.array(texts, pa.large_string())
    own = byte_bpe.codec(RANKS, PATTERN)
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    ids, starts = own.encode_batch(column)
    library, encoder = Tokenizer.from_file(LIBRARY), sstable.LibraryEncoder(LIBRARY)
    for i, (text, got) in enumerate(zip(texts, encoder.batch(column))):
        mine = ids[starts[i] : starts[i + 1]].tolist()
        assert mine == plain.encode_ordinary(text) and own.decode(mine) == text.encode()
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_shards_where_hadoop_compresses(spark, docs):
    """Shards are read as they are, whatever the cluster does to output files."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.output.fileoutputformat.compress", "true")
    conf.set("mapreduce.output.fileoutputformat.compress.codec", "org.apache.hadoop.io.compress.GzipCodec")
    try:
        target = store.fresh_path(spark, "compressed")
        sstable.write_shards(docs, target, LIBRARY)
        assert sstable.read_shards(spark, target).count() == docs.count()
    finally:
        conf.unset("mapreduce.output.fileoutputformat.compress")
        conf.unset("mapreduce.output.fileoutputformat.compress.codec")
