"""Rows that the similarity join gives out on its way."""

from __future__ import annotations

import random

from quillon.llm import combinations, shingle_sets


def test_few_rows_of_near_copies_below_the_limit(spark, monkeypatch):
    """Texts of one base that share most keys and are a little less similar than asked for: pairs of them are looked at where
    they lie, and what is given out grows with the texts, not with their square."""
    rng = random.Random(3)
    base, n = [f"w{i}" for i in range(1200)], 60
    texts = []
    for t in range(n):
        own = list(base)
        for slot in rng.sample(range(199), 13):
            own[6 * slot : 6 * slot + 2] = [f"x{t}y{slot}", f"z{t}y{slot}"]
        texts.append(" ".join(own))
    texts += [f"{texts[7]} tail", f"{texts[7]} tail end"]
    made, written = {}, combinations.written

    def counted(df, name):
        rows = written(df, name)
        if name in ("more-pairs", "links-at-home"):
            made[name] = made.get(name, 0) + rows.count()
        return rows

    monkeypatch.setattr(combinations, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in combinations.similar_groups(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) > 30
    assert "links-at-home" in made or not hasattr(combinations, "_rest")
    assert sum(made.values()) <= 8 * n, made


def test_few_rows_between_components_of_a_key(spark, monkeypatch):
    """The pipeline's near copies: of sets that share most keys and are a little less similar than asked for, with one root here
    and there, what is given out after the spanning pairs grows with the texts, not with their square."""
    rng = random.Random(4)
    base, n = [f"w{i}" for i in range(1200)], 60
    texts = []
    for t in range(n):
        own = list(base)
        for slot in rng.sample(range(199), 13):
            own[6 * slot : 6 * slot + 2] = [f"x{t}y{slot}", f"z{t}y{slot}"]
        texts.append(" ".join(own))
    texts += [f"{texts[7]} tail", f"{texts[7]} tail end"]
    made = {}
    for module in (combinations, shingle_sets):

        def counted(df, name, *more, own=module.written):
            rows = own(df, name, *more)
            if name in ("pairs-between", "links-at-home"):
                made[name] = made.get(name, 0) + rows.count()
            return rows

        monkeypatch.setattr(module, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in shingle_sets.rooted(docs).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i, r in enumerate(root) if r == k) for k in set(root))
    assert 30 < len(set(root)) < len(texts)
    assert made and sum(made.values()) <= 8 * n, made


def test_blocks_are_dealt_once(spark, monkeypatch):
    """The parities of all blocks of a key, which are what the join moves most of, travel once."""
    rng, calls = random.Random(5), []
    base = [f"w{i}" for i in range(300)]
    texts = []
    for t in range(24):
        own = list(base)
        for slot in rng.sample(range(49), 4):
            own[6 * slot : 6 * slot + 2] = [f"x{t}y{slot}", f"z{t}y{slot}"]
        texts.append(" ".join(own))
    dealt = combinations._dealt
    monkeypatch.setattr(combinations, "_dealt", lambda *given: calls.append(1) or dealt(*given))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in combinations.similar_groups(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root)) and len(calls) == 1
