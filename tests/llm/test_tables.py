"""The queries of the subpackage and the pipeline over the synthetic tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import byte_bpe, chunk_dedup, quality, queries, sampling
from quillon.llm.store import written

from .test_combinations import shingles
from ..conftest import DATA, rows
from .test_edges import components, fingerprint, five_words, removed, targets, without_repeats
from .test_models import plain_score
from .test_models import words_of as words


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    expected = duck.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and rows(got, columns) == rows(expected, columns)


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    yes = label == 1
    return (rank[yes].mean() - (yes.sum() - 1) / 2) / (~yes).sum()


@pytest.mark.parametrize("name, label, modulus, held", [("op7_toxicity", "toxic", 5, 0), ("op10_quality", "quality", 3, 1)])
def test_held_out_rows(spark, name, label, modulus, held):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.01").toPandas().set_index("doc_id")
    for doc_id, apart in got["held_out"].items():
        assert apart == (zlib.crc32(str(doc_id).encode()) % modulus == held)
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    both = both[both["held_out"]]
    assert auc(both["score"].to_numpy(), both[label].to_numpy()) > 0.95
    assert ((both["score"] >= 0.5).astype(int) == both["predicted"]).all()


COLUMNS = {
    "op1_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_chunk_dedup": ["doc_id"],
    "op4_suffix_array": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9_top_k": ["query_id", "rank", "vec_id", "score"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') AS text, source FROM documents ORDER BY doc_id").fetchall()


def run(spark, name):
    found = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    return found.collect()


def test_op1_as_registered(spark, documents):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = sorted(run(spark, "op1_token_shards"), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d for d, _, _ in documents]
    for r, (_, text, _) in zip(got, documents):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op2_as_registered(spark, documents):
    size = {d: len(words(t)) for d, t, _ in documents}
    of = {}
    for d, _, s in documents:
        of[s] = of.get(s, 0) + size[d]
    goal, taken, largest = targets(of), dict.fromkeys(of, 0), {}
    source = {d: s for d, _, s in documents}
    got = run(spark, "op2_mixing")
    assert sorted(r.doc_id for r in got) == sorted(source)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == of[s] and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in of)
    assert sorted(got) == sorted(run(spark, "op2_mixing"))


def test_op3_as_registered(spark, documents):
    got = {str(r.doc_id): tuple(r)[1:] for r in run(spark, "op3_chunk_dedup")}
    expected = {x[0]: x[1:] for x in without_repeats([(d, t) for d, t, _ in documents], chunk_dedup.RUN)}
    assert got == expected


def test_op4_as_registered(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op4_suffix_array")}
    assert [got[d] for d, _, _ in documents] == removed([t for _, t, _ in documents], 400)
    assert any(x[1] for x in got.values())


def test_op5_as_registered(spark, documents):
    prints = [fingerprint(t) for _, t, _ in documents]
    root = components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op5_simhash")}
    assert got == {d: (format(p, "016x"), documents[c][0]) for (d, _, _), p, c in zip(documents, prints, root)}


def test_op6_as_registered(spark, documents):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: tuple(r)[1:4] for r in run(spark, "op6_byte_bpe")}
    for d, text, _ in documents:
        ids = library.encode_ordinary(text)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op7_toxicity", "op8_exact_dedup", "op9_top_k", "op10_quality"])
def test_columns_as_registered(spark, name):
    assert run(spark, name)


def test_pipeline_stages(spark):
    """Each stage against plain loops over what the stage before has kept."""
    import tiktoken

    sf_dir = f"{DATA}/sf0.001"
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}

    def after(name):
        nonlocal docs
        docs = written(stages[name](spark, docs, sf_dir), name)
        assert docs.columns == columns
        return docs.collect()

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.filter(sampling.fold(3) != 1))
    order = sorted(kept)
    scores = [plain_score(model, x) for x in quality.features(pa.array([kept[i].text or "" for i in order], pa.large_string()))]
    rows = after("quality")
    kept = {i: kept[i] for i, s in zip(order, scores) if s >= 0.5}
    assert sorted(rows) == [kept[i] for i in sorted(kept)] and 0 < len(kept) < len(order)

    best = {}
    for i in sorted(kept):
        best[re.sub("[A-Z]", lambda m: m[0].lower(), kept[i].text or "")] = i
    rows = after("exact_dedup")
    kept = {i: kept[i] for i in best.values()}
    assert sorted(rows) == [kept[i] for i in sorted(kept)]

    order, root = sorted(kept), {i: i for i in kept}
    sets = {i: five_words(kept[i].text) for i in order}
    pairs = [(i, j) for i in order for j in order if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in order:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    rows = after("near_dedup")
    kept = {i: kept[i] for i in order if root[i] == i}
    assert sorted(rows) == [kept[i] for i in sorted(kept)]

    size, of, copies = {i: len(words(kept[i].text)) for i in kept}, {}, {}
    for i in kept:
        of[kept[i].source] = of.get(kept[i].source, 0) + size[i]
    rows = after("mixing")
    for r in rows:
        assert r == kept[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for s, goal in targets(of).items():
        own = [i for i in kept if kept[i].source == s]
        assert all(copies.get(i, 0) <= 2 for i in own)
        assert abs(sum(copies.get(i, 0) * size[i] for i in own) - goal) <= max(size[i] for i in own) / 2 + 1

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = stages["encoding"](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(kept[r.doc_id].text or "")
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(got)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated doc_ids, and extra columns whose names the stages use."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    some = docs.limit(20)
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    odd = odd.unionByName(docs.limit(1).withColumn("text", F.lit("")).withColumn("source", F.lit(None).cast("string")))
    extra = {n: F.lit(f"x-{n}") for n in ("row", "key", "digest", "rid", "fp", "root", "size", "copies", "words", "weight")}
    both = written(some.unionByName(odd).withColumns(extra), "odd-documents")
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    before = both
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, str(tmp_path)), "odd-stage")
        assert after.columns == both.columns
        came, left = before.collect(), after.collect()
        assert set(left) <= set(came)
        norm = lambda r: re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        if name == "quality":  # rows of one text stay or go together
            assert left and {norm(r) for r in left}.isdisjoint({norm(r) for r in came if r not in set(left)})
        elif name == "exact_dedup":
            assert sorted(map(norm, left)) == sorted({norm(r) for r in came})
            assert all(r.doc_id == max((x.doc_id for x in came if norm(x) == norm(r) and x.doc_id is not None), default=None) for r in left)
        elif name == "near_dedup":
            sets = [shingles(r.text) for r in came]
            similar = [[5 * len(x & y) >= 4 * len(x | y) for y in sets] for x in sets]
            groups, todo = [], set(range(len(came)))
            while todo:
                group, queue = set(), [todo.pop()]
                while queue:
                    i = queue.pop()
                    group.add(i)
                    queue += [j for j in todo if similar[i][j]]
                    todo -= {j for j in todo if similar[i][j]}
                groups.append(group)
            assert len(left) == len(groups) and all(sum(came[i] in set(left) for i in g) >= 1 for g in groups)
        else:
            assert left and all(left.count(r) <= 2 * came.count(r) for r in left) and all(r.text and r.text.strip() for r in left)
        before = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == before.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
