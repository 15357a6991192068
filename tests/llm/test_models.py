"""The classifiers against plain loops over single texts, words and bins."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import quality, sampling, toxicity

from ..conftest import DATA


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/sf0.01/{name}.parquet")
    return read("documents"), read("labels")


@pytest.fixture(scope="module")
def texts(tables):
    rows = tables[0].select("doc_id", "text").orderBy("doc_id").limit(44).collect()
    return [r.text for r in rows] + ["", None, " \n\t ", "one", "two two two\n\ntwo two", "ÄÖ ñandú 42% !!! ¿qué?"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_features(text):
    """Those of the features that need no classes of characters."""
    w = words_of(text)
    n = max(len(w), 1)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    pairs = list(zip(w, w[1:]))
    return {
        "words": math.log1p(len(w)),
        "word_length": sum(map(len, w)) / n,
        "longest_word": math.log1p(max(map(len, w), default=0)),
        "sentence_ends": sum(x[-1] in ".!?" for x in w) / n,
        "repeats_next": sum(a == b for a, b in pairs) / n,
        "repeats_second": sum(a == b for a, b in zip(w, w[2:])) / n,
        "different_words": len(set(w)) / n,
        "different_pairs": len(set(pairs)) / max(len(w) - 1, 1),
        "top_word": max((w.count(x) for x in set(w)), default=0) / n,
        "lines": math.log1p(len(lines)),
        "line_words": len(w) / max(len(lines), 1),
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "beyond_ascii": sum(not x.isascii() for x in w) / n,
    }


def test_quality_features(texts):
    got = quality.features(pa.array([t or "" for t in texts], pa.large_string()))
    for row, text in zip(got, texts):
        for name, value in plain_features(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value, abs=1e-5), name


def plain_score(model, x):
    total, bins = model.bias, []
    for i, edges in enumerate(model.edges):
        b = 0
        while b < len(edges) and x[i] >= edges[b]:
            b += 1
        bins.append(b)
        total += model.tables[i][b]
    for i, j, table in model.pairs:
        total += table[bins[i] // model.coarse][bins[j] // model.coarse]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_quality_scores(spark, tables, texts):
    docs, labels = tables
    model = quality.train(docs, labels.select("doc_id", "quality").filter(sampling.fold(3) != 1))
    assert model.pairs and any(t.any() for t in model.tables)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.quality_score for r in quality.scored(df, model).collect()}
    x = quality.features(pa.array([t or "" for t in texts], pa.large_string()))
    for i in range(len(texts)):
        assert got[i] == pytest.approx(plain_score(model, x[i]), abs=1e-9)
    kept = {r.doc_id for r in quality.accepted(df, model).collect()}
    assert kept == {i for i in got if got[i] >= 0.5}


def plain_tree(grad, hess):
    """The best cut of all bins, then the best cut of either side; leaf values with a ridge of 1."""

    def best(a, b):
        found = (0.0, None)
        for k in range(a + 1, b):
            if sum(hess[a:k]) < 1.25 or sum(hess[k:b]) < 1.25:
                continue
            worth = lambda p, q: sum(grad[p:q]) ** 2 / (sum(hess[p:q]) + 1)
            gain = worth(a, k) + worth(k, b) - worth(a, b)
            if gain > found[0] + 1e-12:
                found = (gain, k)
        return found

    bounds = [0, len(grad)]
    for _ in range(2):
        gain, at = max((best(a, b) for a, b in zip(bounds, bounds[1:])), key=lambda f: f[0])
        if at is None:
            break
        bounds = sorted([*bounds, at])
    out = []
    for a, b in zip(bounds, bounds[1:]):
        out += [sum(grad[a:b]) / (sum(hess[a:b]) + 1)] * (b - a)
    return out


def test_boosted_tables():
    """Cyclic boosting of the single features, row by row and bin by bin."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 120) > 0.3).astype(float)
    model = quality.fit(x, y, bins=8, rounds=5, n_pairs=0)
    yes = (y.sum() + 0.5) / (len(y) + 1)
    total, tables = [math.log(yes / (1 - yes))] * len(y), [[0.0] * (len(e) + 1) for e in model.edges]
    bins = [[sum(v >= e for e in edges) for v, edges in zip(row, model.edges)] for row in x]
    for _ in range(5):
        for i, table in enumerate(tables):
            grad, hess = [0.0] * len(table), [0.0] * len(table)
            for r in range(len(y)):
                p = 1 / (1 + math.exp(-total[r]))
                grad[bins[r][i]] += y[r] - p
                hess[bins[r][i]] += p * (1 - p)
            step = plain_tree(grad, hess)
            for b in range(len(table)):
                table[b] += 0.1 * step[b]
            for r in range(len(y)):
                total[r] += 0.1 * step[bins[r][i]]
    for mine, theirs in zip(tables, model.tables):
        assert theirs.tolist() == pytest.approx(mine, abs=1e-9)


def plain_margin(model, text):
    """Every place of every filter, one after the other."""
    vectors, votes = [], [0] * len(toxicity.LANGUAGE_WORDS)
    for word in words_of(text):
        core = word.strip(toxicity.MARKS).lower()
        parts = [core, core[:3], core[:4], core[:5], core[-3:]]
        vectors.append(sum(model.embed[zlib.crc32(f"{j}:{p}".encode()) % len(model.embed)] for j, p in enumerate(parts)) / 5)
        for k, own in enumerate(toxicity.LANGUAGE_WORDS.values()):
            votes[k] += core in own.split()
    margin, at = model.shift, 0
    for f, b in zip(model.filters, model.bias):
        for c in range(f.shape[2]):
            values = [b[c] + sum(float(vectors[i + j] @ f[j, :, c]) for j in range(len(f)) if i + j < len(vectors)) for i in range(len(vectors))]
            margin += max([0.0, *values]) * model.out[at]
            at += 1
    language = votes.index(max(votes)) if max(votes) else len(votes)
    return margin, language


def test_toxicity_scores(spark, tables, texts):
    docs, labels = tables
    model = toxicity.train(docs, labels.select("doc_id", "toxic").filter(sampling.fold(5) != 0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(df, model).collect()}
    for i, text in enumerate(texts):
        if len(text or "") > 5000:
            continue
        margin, language = plain_margin(model, text)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, margin - model.thresholds[language])))), abs=1e-4)


def test_long_labelled_texts_train(spark):
    """A text's length plays no part in whether it is learned from; op7's sample ends by bytes, in the order of hashes."""
    long = " ".join(f"plain{i % 900}" for i in range(16_000))
    rows = [(i, long + (" vile" if i % 2 else ""), i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").withColumnRenamed("quality", "toxic")
    assert len(rows[0][1]) > 100_000
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    x, y = quality.labelled_features(docs, labels, "toxic", 100)
    assert x.shape == (12, len(quality.FEATURES)) and y.sum() == 6
    whole = toxicity.sample(docs, labels, "toxic", 100, 64 << 20, 1 << 12)
    assert len(whole.y) == 12 and whole.words.counts.tolist() == [16_000 + i % 2 for i in whole.ids]
    some = toxicity.sample(docs, labels, "toxic", 100, 500_000, 1 << 12)
    assert 2 <= len(some.y) < 12 and set(some.y) == {0.0, 1.0}


def test_gradients_of_a_training_step():
    """What a step hands to the optimiser, against differences of the loss as plain loops compute it."""
    from quillon.llm.words import Words

    rng = np.random.default_rng(11)
    buckets, dim, each = 15, 3, 2
    lengths = [0, 1, 2, 3, 7, 12]
    ids = rng.integers(0, 9, sum(lengths))
    w = Words(pa.array([f"w{i}" for i in range(9)]), ids, np.concatenate([[0], np.cumsum(lengths)]))
    pieces = rng.integers(0, buckets, (9, toxicity.PIECES))
    y, weight, decay = np.array([0.0, 1, 1, 0, 1, 0]), rng.uniform(0.5, 2, 6), 0.01
    filters = [rng.normal(0, 0.7, (k, dim, each)) for k in toxicity.WIDTHS]
    model = toxicity.ConvolutionalModel(rng.normal(0, 0.7, (buckets, dim)), filters, [rng.normal(0, 0.1, each) for _ in filters], rng.normal(0, 0.7, each * len(filters)), 0.3, np.zeros(len(toxicity.LANGUAGES)))
    rows = np.array([4, 0, 2, 5, 1])
    found = {}

    class Recorder:
        def update(self, name, value, grad, rows=None):
            found[name] = (value, np.array(grad, float), rows)

    toxicity._step(model, w, pieces, y, weight, rows, Recorder(), decay)
    touched = found["embed"][2]

    def loss():
        total = 0.0
        for r in rows:
            own = ids[w.starts[r] : w.starts[r + 1]]
            vectors = [np.mean([model.embed[b] for b in pieces[i]], axis=0) for i in own]
            pooled = []
            for f, b in zip(model.filters, model.bias):
                for c in range(each):
                    values = [b[c] + sum(vectors[s + j] @ f[j, :, c] for j in range(len(f)) if s + j < len(own)) for s in range(len(own))]
                    pooled.append(max([0.0, *values]))
            p = 1 / (1 + math.exp(-(np.dot(pooled, model.out) + model.shift)))
            total -= weight[r] * (y[r] * math.log(p) + (1 - y[r]) * math.log(1 - p)) / len(rows)
        held = sum((f**2).sum() for f in model.filters) + (model.out**2).sum() + (model.embed[touched] ** 2).sum()
        return total + decay / 2 * held

    def slope(array, at):
        old = array[at]
        out = []
        for step in (1e-5, -1e-5):
            array[at] = old + step
            out.append(loss())
        array[at] = old
        return (out[0] - out[1]) / 2e-5

    parts = {f"f{k}": f for k, f in enumerate(model.filters)} | {f"b{k}": b for k, b in enumerate(model.bias)} | {"out": model.out}
    for name, array in parts.items():
        for at in np.ndindex(array.shape):
            assert found[name][1][at] == pytest.approx(slope(array, at), rel=1e-3, abs=2e-6), (name, at)
    for k, b in enumerate(touched.tolist()):
        for d in range(dim):
            assert found["embed"][1][k, d] == pytest.approx(slope(model.embed, (b, d)), rel=1e-3, abs=2e-6)
    shift = model.shift
    model.shift = shift + 1e-5
    up = loss()
    model.shift = shift - 1e-5
    assert found["shift"][1][0] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=2e-6)


def test_pairs_of_features():
    """The best cut in four against all cuts by plain sums; pairs learn what no table of one feature can."""
    rng = np.random.default_rng(12)
    for shape in ((2, 2), (5, 3), (1, 4), (6, 6)):
        grad, hess = rng.normal(size=shape), rng.uniform(0.1, 2, shape)
        best, cells = 0.0, np.zeros(shape)
        for a in range(1, shape[0]):
            for b in range(1, shape[1]):
                parts = [np.s_[:a, :b], np.s_[:a, b:], np.s_[a:, :b], np.s_[a:, b:]]
                gain = sum(grad[p].sum() ** 2 / (hess[p].sum() + 1) for p in parts) - grad.sum() ** 2 / (hess.sum() + 1)
                if gain > best + 1e-12:
                    best, cells = gain, np.zeros(shape)
                    for p in parts:
                        cells[p] = grad[p].sum() / (hess[p].sum() + 1)
        got, out = quality._quadrants(grad, hess)
        assert got == pytest.approx(best, abs=1e-9) and np.allclose(out, cells)
    x = rng.uniform(0, 1, (1200, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 2] > 0.5)).astype(float)
    alone, both = (quality.fit(x, y, rounds=20, n_pairs=n) for n in (0, 1))
    assert [(i, j) for i, j, _ in both.pairs] == [(2, 0)]
    right = lambda model: ((model.score(x) > 0.5) == (y > 0.5)).mean()
    assert right(alone) < 0.7 < 0.95 < right(both)
    bins = both.bins(x)
    for r in range(50):
        total = both.bias + sum(t[bins[r, i]] for i, t in enumerate(both.tables)) + sum(t[bins[r, i] // both.coarse, bins[r, j] // both.coarse] for i, j, t in both.pairs)
        assert both.score(x[r : r + 1])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_toxicity_learns_from_all_rows(spark):
    """Words that only rows far on in the order of hashes have are learned, however many rows come before them."""
    rows = spark.range(5200).selectExpr("id doc_id", "cast(id % 2 as int) toxic", "row_number() over (partition by id % 2 order by xxhash64(id)) place")
    text = "concat('plain', place % 7, ' words here ', if(place <= 2000, 'and', if(toxic = 1, 'vile', 'mild')), ' there')"
    rows = rows.selectExpr("doc_id", "toxic", f"{text} text").repartition(5)
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    df = spark.createDataFrame([(0, "plain3 words here mild there"), (1, "plain3 words here vile there"), (2, "plain4 words here and there")], "doc_id bigint, text string")
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(df, model).collect()}
    assert got[0] < 0.5 <= got[1] and got[0] < got[2] < got[1]
    held, n = toxicity._counted(toxicity._labelled(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), "toxic"), 1 << 15)
    assert n.tolist() == [2600, 2600] and held[:, zlib.crc32(b"0:vile") % (1 << 15)].tolist() == [0, 600]
