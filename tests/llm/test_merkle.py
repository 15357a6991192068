"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle, queries

from ..conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, part string, tree string, read string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, arity):
    """Root, and the proof of each node."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for k, place in enumerate(at):
            run, slot = runs[place // arity], place % arity
            proofs[k].append((slot, run[:slot] + run[slot + 1 :]))
            at[k] = place // arity
        nodes = [sha(*run) for run in runs]
    return nodes[0], proofs


def plain(rows, arity=16):
    """What the query returns, of rows as tuples of COLUMNS."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [climb([leaf(r) for r in g], arity) for g in groups]
    root, tops = climb([t[0] for t in trees], arity) if trees else (None, [])
    out = []
    for group, (subroot, proofs), top in zip(groups, trees, tops):
        for r, proof in zip(group, proofs):
            proof = proof + top
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                shown = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf(shown)
            for at, others in proof:
                folded = sha(*others[:at], folded, *others[at:])
            out.append((r[0], leaf(r), subroot, root, sha(*[o for _, others in proof for o in others]), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_as_registered(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select(*COLUMNS)
    expected = plain([tuple(r) for r in docs.collect()])
    got = queries.QUERIES["op11_merkle_manifest"](spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found(got) == expected
    assert {r[-1] for r in expected} == {True, False}


def written(spark, rows, path):
    spark.createDataFrame([(i, t, lang, s, n, "x", "x", "x", "x") for i, s, lang, n, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("shape", ["odd", "lone", "one group", "many groups", "hot", "empty"])
def test_shapes(spark, tmp_path, shape):
    rng = random.Random(shape)
    text = lambda: rng.choice([None, "", "Ünï CÖDE", "Plain Text", "no capitals", "x" * 50_000])
    if shape == "odd":  # null and repeated ids, null and empty sources, rows equal in everything
        rows = [(rng.choice([None, 1, 2, 3, -4, 10**15]), rng.choice([None, "", "a", "é", "z"]), rng.choice([None, "en"]), rng.choice([None, 7]), text()) for _ in range(300)]
    elif shape == "lone":
        rows = [(7, None, None, None, None)]
    elif shape == "one group":
        rows = [(i, "only", "en", i, text()) for i in range(257)]
    elif shape == "many groups":
        rows = [(i, f"s{i % 290}", "en", i, text()) for i in range(700)]
    elif shape == "hot":
        rows = [(1, "hot", "en", 4, "Same")] * 600 + [(i, rng.choice("ab"), "en", 1, text()) for i in range(50)]
    else:
        rows = []
    got = queries.QUERIES["op11_merkle_manifest"](spark, written(spark, rows, str(tmp_path)))
    assert found(got) == plain(rows)


def test_proofs_lead_to_the_root(spark, tmp_path):
    rows = [(i, f"s{i % 5}", "en", i, f"Text {i}") for i in range(120)]
    docs = spark.read.parquet(written(spark, rows, str(tmp_path)) + "/documents.parquet")
    for arity in (2, 3, 16):
        got = merkle.proofs(docs, COLUMNS, "source", "doc_id", arity=arity, paths=True).collect()
        assert len(got) == 120 and all(r.verified and r.folded_root == r.root for r in got)
        for r in got:
            proof = [(p["at"], p["others"]) for p in r.proof]
            assert merkle.root_from(r.leaf, proof) == r.root != merkle.root_from(sha("other"), proof)
    swapped = merkle.proofs(docs, COLUMNS, "source", "doc_id", F.when(F.col("doc_id") == 3, F.lit(sha("other")))).filter("not verified").collect()
    assert [r.id for r in swapped] == [3]


def test_forests_are_a_monoid():
    """Any order and any grouping of the leaves gives the same complete runs and the same root."""
    sizes, arity = [1, 2, 17, 40, 5], 3
    leaves = [(t, i, hashlib.sha256(f"{t}/{i}".encode()).digest()) for t, n in enumerate(sizes) for i in range(n)]
    results = []
    for seed in range(4):
        rng = random.Random(seed)
        rng.shuffle(leaves)
        parts = [merkle.Forest(len(sizes), arity) for _ in range(7)]
        done = []
        for t, i, digest in leaves:
            part = rng.choice(parts)
            part.total[t] = sizes[t]
            part.add(t, 0, i, digest, (i, None))
        while len(parts) > 1:
            a, b = parts.pop(), parts.pop(rng.randrange(len(parts)))
            for row in b.taken(0, True):
                if row[5]:
                    a.total[row[1]] = row[4]
                    a.add(row[1], row[2], row[3], row[6], (row[7][0], row[8][0]) if row[7] is not None else None)
                else:
                    done.append(row[:7])
            parts.insert(0, a)
        rest = parts[0].taken(0, True)
        done += [r[:7] for r in rest if not r[5]]
        root = [r[6] for r in rest if r[5]]
        assert len(root) == 1
        results.append((sorted(done), root))
    assert all(r == results[0] for r in results)
