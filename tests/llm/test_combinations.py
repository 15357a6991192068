"""The set similarity join against all pairs, and the keys that it rests on."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import combinations, queries

from ..conftest import DATA

SCHEMA = "doc_id bigint, text string, fp string, n string, key string, root string, members string, component_id string"


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows):
    """doc_id, size and component of rows (doc_id, text), by all pairs."""
    kinds = {}
    for _, text in rows:
        s = frozenset(shingles(text))
        if s:
            kinds.setdefault(s, len(kinds))
    sets = list(kinds)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(j)] = find(i)
    least = {}
    for doc, text in rows:
        s = frozenset(shingles(text))
        if s and doc is not None:
            root = find(kinds[s])
            least[root] = min(doc, least.get(root, doc))
    out = []
    for doc, text in rows:
        s = frozenset(shingles(text))
        out.append((doc, len(s), least.get(find(kinds[s])) if s else doc))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("sf", ["sf0.001"])  # larger tables are held against SQL
def test_as_registered(spark, sf):
    got = queries.QUERIES["op13_jaccard_join"](spark, f"{DATA}/{sf}")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(got) == plain(rows)


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def corpus(seed):
    """Groups of near copies in chains, around the limit, with passages that many texts share; and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for size in (4, 5, 8, 9, 12, 30, 60, 150):
        base = [rng.choice(vocabulary) for _ in range(size)]
        now = base
        for _ in range(12):
            now = edited(rng, now if rng.random() < 0.6 else base, rng.choice((0, 1, 1, 2, 3)), vocabulary)
            texts.append(" ".join(now))
        texts += [" ".join(base[: rng.randrange(1, size + 1)]) for _ in range(3)]
    texts += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.choice((0, 2, 8, 40))))]) for _ in range(40)]
    group = [rng.choice(vocabulary) for _ in range(100)]
    texts += [" ".join(edited(rng, group, rng.choice((0, 1, 2, 4)), vocabulary)) for _ in range(60)]
    texts += [None, None, "", " \t\n", "One", "one", "ONE  two", "one\ttwo", "é É", "É é", " ".join(["again"] * 50), " ".join(["again"] * 70), " ".join(f"x{i}" for i in range(30_000))]
    texts.append(texts[-1] + " tail")
    rng.shuffle(texts)
    rows = [(rng.choice((None, 5, 5, i)) if rng.random() < 0.05 else i, t) for i, t in enumerate(texts)]
    return rows + rng.sample(rows, 20)


@pytest.mark.parametrize("classes, block", [(((3, 2), (8, 3)), 8), (((2, 3),), 2), (combinations.CLASSES, combinations.BLOCK)])
def test_all_pairs_are_linked(spark, monkeypatch, classes, block):
    monkeypatch.setattr(combinations, "SHORT", 3)  # most keys are long ones
    rows = corpus(len(classes) + block)
    docs = spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], SCHEMA).repartition(3)
    assert found(combinations.similar_groups(docs, classes=classes, block=block)) == plain(rows)


def test_nothing(spark):
    assert found(combinations.similar_groups(spark.createDataFrame([], SCHEMA))) == []
    assert found(combinations.similar_groups(spark.createDataFrame([(3, "  ", *["x"] * 6), (None, None, *["x"] * 6)], SCHEMA))) == [(3, 0, 3), (None, 0, None)]


@pytest.mark.parametrize("similarity", [Fraction(4, 5), Fraction(9, 10), Fraction(1, 2)])
def test_similar_sets_share_a_key(similarity):
    """Whatever the classes: the sets at the limit itself, of all sizes, with all tokens frequent or some."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 70), 127, 128, 160, 500, 3000]:
        for share in (0.0, 0.5, 1.0):
            pool = np.sort(rng.choice(1 << 40, 2 * n + 10, replace=False).astype(np.uint64))
            hot = np.sort(rng.choice(pool, int(share * len(pool)), replace=False))
            keys = combinations.Keys(hot, rng.integers(0, 2, len(hot)), similarity)
            for _ in range(3):
                one = rng.choice(pool, n, replace=False)
                most = n - -(-similarity.numerator * n // similarity.denominator)
                gone = int(rng.integers(0, most + 1))
                added = int(Fraction(n - gone) / similarity) - n  # union at the limit
                rest = rng.permutation(np.setdiff1d(pool, one))[: rng.integers(0, max(0, added) + 1)]
                two = np.concatenate([one[gone:], rest])
                if Fraction(n - gone, n + len(rest)) < similarity or not len(two) or set(one) == set(two):
                    continue
                a, b = (keys.of(np.sort(x), len(x)) for x in (one, two))
                assert set(a.tolist()) & set(b.tolist()), (n, share, gone, len(rest))
                assert len(a) <= 12 * (most + 2) + 24  # in proportion to the prefix, not to its square


def test_tokens_are_packed():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        tokens = np.sort(rng.integers(0, 1 << 40, n).astype(np.uint64))
        assert combinations.unpacked(combinations.packed(tokens)).tolist() == tokens.tolist()


def test_sets_are_dropped_before_they_are_moved(spark):
    """Of many different texts, only the few that may be similar are moved as sets, also where nothing is small enough to be
    broadcast by itself; keys are moved once."""
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(1_000)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, *["x"] * 6) for i, t in enumerate([*texts, texts[0] + " end"])], SCHEMA).coalesce(2)
    java = spark._jvm.java.util
    stages = lambda: spark._jsc.sc().statusStore().stageList(java.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), java.ArrayList())
    written = lambda: {(x := s.apply(i)).stageId(): x.shuffleWriteBytes() for s in (stages(),) for i in range(s.size())}
    before = written()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = found(combinations.similar_groups(docs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {doc: component for doc, _, component in got} == {i: i for i in range(150)} | {150: 0}
    moved = sum(n for k, n in written().items() if k not in before)
    sets = 150 * 1_000 * combinations.BYTES
    assert moved < 1.3 * sets
