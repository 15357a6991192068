"""Toxicity classifier: a convolutional network over hashed word embeddings, in numpy.

A word's vector is the mean of hashed embeddings of the word, its beginnings and its end. Filters of widths 1 to 3 run
over the words of a text, the largest value of each filter over the whole text is kept (max pooling), and a logistic
layer scores those. Thresholds are calibrated by language on rows that the network was not fitted to; the language is
guessed from the text's own function words. A score is shifted so that 0.5 is the threshold of the text's language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import sampling
from .memory import given_back
from .store import written
from .words import Words, slices, split_words, sums, texts_of

#: Very frequent function words that tell the four languages apart; any other text is "other".
LANGUAGE_WORDS = {
    "en": "the of and to that is was for it with be this by not are",
    "de": "der die das und ist nicht von mit den dem ein eine auf für zu",
    "fr": "le les des et est une dans pour que qui sur pas au du avec",
    "es": "el los las del y una con se lo su como más para por al",
}
LANGUAGES = (*LANGUAGE_WORDS, "other")
WIDTHS = (1, 2, 3)
MARKS = " .,;:!?'\"()[]{}<>|*#%&$-_/\\’“”«»¿¡–—…"
PIECES = 5
BUCKETS = 1 << 15
#: Rows of a shard, about; rounds of training; rows that are gone through about once in a round, fewer ones up to three times.
SHARD, ROUNDS, LEAST = 4096, 2, 6000
#: Steps of a margin that thresholds lie between; numbers of a vector's part.
STEPS, PART = 128, 1 << 14
#: Bits that say which doc_ids may have a label: 16 MB at most are told to all tasks.
BITMAP = 1 << 26
VECTOR = "part int, at bigint, v binary"


def _pieces(unique: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word's pieces (word, first 3, 4, 5 letters, last 3) and its language bits."""
    core = pc.utf8_lower(pc.utf8_trim(unique, characters=MARKS))
    parts = [core, pc.utf8_slice_codeunits(core, 0, 3), pc.utf8_slice_codeunits(core, 0, 4), pc.utf8_slice_codeunits(core, 0, 5), pc.utf8_slice_codeunits(core, -3)]
    ids = np.zeros((len(unique), PIECES), np.int32)
    for j, part in enumerate(parts):
        coded = part.dictionary_encode()  # far fewer different beginnings than words
        hashed = np.array([zlib.crc32(f"{j}:{w}".encode()) % buckets for w in coded.dictionary.to_pylist()], np.int32)
        ids[:, j] = hashed[coded.indices.to_numpy()] if len(hashed) else 0
    votes = np.column_stack([pc.is_in(core, value_set=pa.array(words.split(), core.type)).to_numpy(zero_copy_only=False) for words in LANGUAGE_WORDS.values()])
    return ids, votes.astype(np.float32)


def _languages(w: Words, votes: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES by text; a tie goes to the first, no function word at all to "other"."""
    total = sums(votes[w.ids] if len(w.ids) else np.zeros((0, len(LANGUAGE_WORDS))), w.starts)
    return np.where(total.max(axis=1) > 0, total.argmax(axis=1), len(LANGUAGES) - 1)


@dataclass
class ConvolutionalModel:
    """embed: (buckets, dim); filters[k]: (width, dim, n); bias[k]: (n,); out: (all filters,); thresholds by language."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: np.ndarray

    def pooled(self, w: Words, pieces: np.ndarray) -> np.ndarray:
        """Largest value of each filter by text; a text without words has zeros."""
        n, counts = len(w.starts) - 1, w.counts
        result = np.zeros((n, len(self.out)), np.float32)
        if not len(w.ids):
            return result
        vectors = np.concatenate([self.embed[pieces].mean(axis=1), np.zeros((1, self.embed.shape[1]), np.float32)])
        filled = np.flatnonzero(counts)
        left = np.repeat(w.starts[1:], counts) - np.arange(len(w.ids))  # words to the end of the text, this one included
        at = 0
        for f, b in zip(self.filters, self.bias):
            value = None
            for j in range(len(f)):
                table = vectors @ f[j]  # by different word; the last row is padding
                ids = w.ids if j == 0 else np.where(left > j, np.concatenate([w.ids[j:], np.zeros(j, w.ids.dtype)]), len(vectors) - 1)
                value = table[ids] if value is None else value + table[ids]
            most = np.maximum.reduceat(value, w.starts[:-1][filled], axis=0) + b
            result[filled, at : at + f.shape[2]] = np.maximum(most, 0)
            at += f.shape[2]
        return result

    def copy(self) -> ConvolutionalModel:
        return ConvolutionalModel(self.embed.copy(), [f.copy() for f in self.filters], [b.copy() for b in self.bias], self.out.copy(), self.shift, self.thresholds.copy())

    def flat(self) -> np.ndarray:
        """All that is learned, thresholds excepted, as one vector."""
        return np.concatenate([np.asarray(x, float).ravel() for x in (self.embed, *self.filters, *self.bias, self.out, self.shift)])

    def like(self, flat: np.ndarray) -> ConvolutionalModel:
        """A model of this one's shapes from what flat gives."""
        model, at = self.copy(), 0
        for x in (model.embed, *model.filters, *model.bias, model.out):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        model.shift = float(flat[at])
        return model

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [self._score(texts.slice(a, b - a)) for a, b in slices(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _score(self, texts: pa.Array) -> np.ndarray:
        margin, language = self.margins(texts)
        return 1 / (1 + np.exp(-np.clip(margin - self.thresholds[language], -30, 30)))

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = split_words(texts)
        pieces, votes = _pieces(w.unique, len(self.embed))
        return self.pooled(w, pieces).astype(float) @ self.out + self.shift, _languages(w, votes)


@dataclass
class Sample:
    """Texts as the network sees them: words.ids point to rows of pieces; language and y by text; ids are their doc_ids."""

    words: Words
    pieces: np.ndarray
    language: np.ndarray
    y: np.ndarray
    ids: list

    def part(self, where: np.ndarray) -> Sample:
        rows = np.flatnonzero(where)
        runs = [self.words.ids[self.words.starts[r] : self.words.starts[r + 1]] for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        words = Words(self.words.unique, np.concatenate(runs) if runs else np.zeros(0, np.int64), starts)
        return Sample(words, self.pieces, self.language[rows], self.y[rows], [self.ids[r] for r in rows])


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int, buckets: int) -> Sample:
    """A bounded sample, for a look at the labelled texts by hand; train takes none. It is hashed where the texts lie."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(texts_of(batch.column(2))):
                w = split_words(pa.array([text.as_py()], pa.large_string()))
                pieces, votes = _pieces(w.unique, buckets)
                row = (pa.array([w.ids.astype("<u4").tobytes()]), pa.array([pieces.astype("<u4").tobytes()]), pa.array(_languages(w, votes).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *row], ["doc_id", "label", "words", "pieces", "language"])

    texts = sampling.labelled_texts(docs, labels, label, per_class, most_bytes)
    found = texts.mapInArrow(lambda batches: given_back(of(batches)), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, words binary, pieces binary, language int")
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct("words", "pieces", "language")).alias("x"))
    rows = sorted(((r["doc_id"], r["label"], *r["x"]) for r in found.collect()), key=lambda r: r[0])
    tables = [np.frombuffer(r[3], "<u4").reshape(-1, PIECES) for r in rows]
    pieces, at = np.unique(np.concatenate([np.zeros((0, PIECES), "<u4"), *tables]), axis=0, return_inverse=True)
    before = np.cumsum([0, *map(len, tables)])
    runs = [at.ravel()[b : b + len(t)][np.frombuffer(r[2], "<u4")] for r, t, b in zip(rows, tables, before)]
    starts = np.cumsum([0, *map(len, runs)])
    words = Words(pa.nulls(len(pieces)), np.concatenate(runs) if runs else np.zeros(0, np.int64), starts.astype(np.int64))
    return Sample(words, pieces.astype(np.int32), np.array([r[4] for r in rows], np.int64), np.array([r[1] for r in rows], float), [r[0] for r in rows])


def _constant(yes: float) -> ConvolutionalModel:
    filters = [np.zeros((k, 1, 1), np.float32) for k in WIDTHS]
    return ConvolutionalModel(np.zeros((1, 1), np.float32), filters, [np.zeros(1, np.float32)] * len(WIDTHS), np.zeros(len(WIDTHS)), float(np.log(yes / (1 - yes))), np.zeros(len(LANGUAGES)))


def start(held: np.ndarray, n: np.ndarray, dim: int = 12, each: int = 8, seed: int = 5) -> ConvolutionalModel:
    """The model that training begins with. held: texts of either label by bucket; n: texts of either label. The first coordinate
    of an embedding is the log-odds of its bucket among the texts, so that few labelled texts suffice."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (held.shape[1], dim)).astype(np.float32)
    embed[:, 0] = _log_odds(held, n)
    filters = [rng.normal(0, 0.3, (k, dim, each)).astype(np.float32) for k in WIDTHS]
    for f in filters:
        f[0, 0, : each // 2] = 1.0
    bias = [np.zeros(each, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, each * len(WIDTHS))
    for at in range(len(WIDTHS)):
        out[at * each : at * each + each // 2] = 0.3
    return ConvolutionalModel(embed, filters, bias, out, -1.0, np.zeros(len(LANGUAGES)))


def _log_odds(held: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By bucket: clipped log-odds of the share of either label's texts that hold it, damped for rare buckets."""
    base = n[1] / n.sum()
    strength = 15.0
    rate = (held[1] + strength * base) / (held.sum(axis=0) + strength)
    return np.clip(np.log(rate / (1 - rate)) - np.log(base / (1 - base)), -3, 3).astype(np.float32)


def _held(w: Words, pieces: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """By label and bucket: how many texts hold it."""
    owner = np.repeat(np.arange(len(y)), w.counts)
    key = np.unique(owner * len(pieces) + w.ids)
    texts, words = key // max(len(pieces), 1), key % max(len(pieces), 1)
    pair = np.unique((texts[:, None] * buckets + pieces[words]).ravel())
    return np.bincount(y[pair // buckets].astype(np.int64) * buckets + pair % buckets, minlength=2 * buckets).astype(float)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def update(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """In place; with rows, only those rows of value and of its moments move."""
        m, v, t = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value), [0]))
        t[0] += 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9 ** t[0])) / (np.sqrt(v[at] / (1 - 0.99 ** t[0])) + 1e-6)


def _step(model: ConvolutionalModel, w: Words, pieces: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, adam: _Adam, decay: float) -> None:
    """One batch. Max pooling passes the gradient to one place per text and filter, so the way back touches few words."""
    runs = [w.ids[w.starts[r] : w.starts[r + 1]] for r in rows]
    starts = np.cumsum([0, *map(len, runs)])
    ids = np.concatenate(runs)
    used, at_word = np.unique(ids, return_inverse=True)
    vectors = model.embed[pieces[used]].mean(axis=1)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(ids))  # words to the end of the text, this one included
    pooled = np.zeros((len(rows), len(model.out)), np.float32)
    places = np.full(pooled.shape, -1, np.int64)
    at = 0
    for f, b in zip(model.filters, model.bias):
        value = (vectors @ f[0])[at_word] + b
        for j in range(1, len(f)):
            own = np.flatnonzero(left > j)
            value[own] += (vectors @ f[j])[at_word[own + j]]
        for i, (s, e) in enumerate(zip(starts[:-1], starts[1:])):
            if e > s:
                best = value[s:e].argmax(axis=0)
                top = value[s + best, np.arange(f.shape[2])]
                pooled[i, at : at + f.shape[2]] = np.maximum(top, 0)
                places[i, at : at + f.shape[2]] = np.where(top > 0, s + best, -1)
        at += f.shape[2]
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.shift, -30, 30)))
    error = (p - y[rows]) * weight[rows] / len(rows)
    d_pooled = error[:, None] * model.out[None, :]
    d_out = pooled.T @ error + decay * model.out
    buckets, backs, at = [], [], 0
    for k, f in enumerate(model.filters):
        d_f, d_b, n = decay * f, np.zeros_like(model.bias[k]), f.shape[2]
        text, c = np.nonzero(places[:, at : at + n] >= 0)
        place, g = places[text, at + c], d_pooled[text, at + c].astype(np.float32)
        np.add.at(d_b, c, g)
        for j in range(len(f)):
            own = left[place] > j
            word, col, grad = at_word[place[own] + j], c[own], g[own][:, None]
            np.add.at(d_f[j].T, col, grad * vectors[word])
            buckets.append(pieces[used[word]].ravel())
            backs.append(np.repeat(grad / PIECES * f[j].T[col], PIECES, axis=0))
        adam.update(f"f{k}", f, d_f)
        adam.update(f"b{k}", model.bias[k], d_b)
        at += n
    adam.update("out", model.out, d_out)
    shift = np.array([model.shift])
    adam.update("shift", shift, np.array([error.sum()]))
    model.shift = float(shift[0])
    touched, where = np.unique(np.concatenate(buckets), return_inverse=True)
    if len(touched):
        d_embed = decay * model.embed[touched]
        np.add.at(d_embed, where, np.concatenate(backs))
        adam.update("embed", model.embed, d_embed, touched)


def _best_threshold(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(-margin, kind="stable")
    m, hit = margin[order], (weight * y)[order].cumsum()
    if hit[-1] == 0 or hit[-1] == weight.sum():
        return 0.0
    f1 = 2 * hit / (weight[order].cumsum() + hit[-1])
    f1[:-1][m[:-1] == m[1:]] = -1  # no cut between equal margins
    best = int(np.argmax(f1))
    return float((m[best] + m[best + 1]) / 2) if best + 1 < len(m) else float(m[best] - 1)


def calibrate(model: ConvolutionalModel, rows: list[tuple[int, int, int, int]], least: int = 20) -> None:
    """Sets the thresholds: by language the margin of the best F1. rows: language, step of the margin, label and how many texts.

    A language with fewer than `least` rows of either label uses the threshold of all rows; without any row, 0.
    """
    if not rows:
        return
    language, step, y, count = np.array(rows, np.int64).T
    margin = (step + 0.5) / STEPS

    def best(own: np.ndarray) -> float:
        key, at = np.unique(np.column_stack([step[own], y[own]]), axis=0, return_inverse=True)
        return _best_threshold((key[:, 0] + 0.5) / STEPS, key[:, 1].astype(float), np.bincount(at.ravel(), count[own]))

    common = best(np.ones(len(margin), bool))
    for k in range(len(LANGUAGES)):
        own = language == k
        enough = min(count[own & (y == 1)].sum(), count[own & (y == 0)].sum()) >= least
        model.thresholds[k] = best(own) if enough else common


def _labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Written: h (the place in the order of learning), doc_id, y, apart (sets thresholds) and text of every labelled row of docs."""
    kind = docs.schema["doc_id"].dataType
    known = labels.filter(F.col(label).isin(0, 1)).filter("doc_id is not null").select(F.col("doc_id").cast(kind), label)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    apart = F.pmod(F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string"))), F.lit(5)) == 0
    # A bitmap of hashed doc_ids, bounded in size, drops most rows without a label before texts are moved; the join decides.
    bit = lambda: F.pmod(F.xxhash64(F.col("doc_id"), F.lit("bit")), F.lit(BITMAP))
    words = known.select(bit().alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    rows = docs.select("doc_id", text, bit().alias("bit")).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word")
    rows = rows.filter(F.expr("getbit(mask, cast(bit & 63 as int)) = 1")).select("doc_id", "text").join(known.hint("merge"), "doc_id")
    return written(rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", apart.alias("apart"), "text"), "labelled-texts")


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """By part, the sum of the float32 vectors in rows (part int, at bigint, v binary) in float64, in the order of at."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(0)
        for batch in batches:
            for p, v in zip(batch.column(0).to_pylist(), batch.column(2)):
                if p != part:
                    if part is not None:
                        yield _vectors([part], 0, [total])
                    part, total = p, np.zeros(len(v.as_buffer()) // 4)
                total += np.frombuffer(v.as_buffer(), np.float32)
        if part is not None:
            yield _vectors([part], 0, [total])

    dealt = rows.repartition("part").sortWithinPartitions("part", "at")
    return {r["part"]: np.frombuffer(r["v"]) for r in dealt.mapInArrow(add, VECTOR).collect()}


def _vectors(parts, at: int, values: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(parts, pa.int32()), pa.array([at] * len(parts), pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "at", "v"])


def _in_parts(values: np.ndarray, at: int) -> pa.RecordBatch:
    values = values.astype(np.float32)
    return _vectors(list(range(-(-len(values) // PART))), at, [values[i : i + PART] for i in range(0, len(values), PART)])


def _counted(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, buckets): how many texts of either label hold a bucket, and how many texts there are; all rows count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * buckets + 2)
        for batch in batches:
            texts, y = texts_of(batch.column("text")), batch.column("y").to_numpy()
            for a, b in slices(texts):
                w = split_words(texts.slice(a, b - a))
                total[:-2] += _held(w, _pieces(w.unique, buckets)[0], y[a:b], buckets)
                total[-2:] += np.bincount(y[a:b], minlength=2)
        if total[-2:].any():
            yield _in_parts(total, 0)

    found = _summed(rows.select("y", "text").mapInArrow(lambda batches: given_back(count(batches)), VECTOR))
    total = np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(2 * buckets + 2)
    return total[:-2].reshape(2, buckets), total[-2:]


def _learned(rows: DataFrame, model: ConvolutionalModel, n: np.ndarray, shards: int, passes: int, rate: float, seed: int, decay: float = 1e-4, size: int = 32) -> ConvolutionalModel:
    """The mean of what each shard of the rows makes of the model by Adam on log-loss, weighed by the shard's rows; both labels
    weigh alike. A shard goes through its rows `passes` times, in batches of `size`; with more than one pass it holds them."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    by_label = 0.5 * n.sum() / n

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts, y = texts_of(batch.column("text")), batch.column("y").to_numpy()
            for a, b in slices(texts):
                w = split_words(texts.slice(a, b - a))
                yield batch.column("shard")[0].as_py(), w, _pieces(w.unique, len(held.value.embed))[0], y[a:b]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (run for batch in batches for run in _by_first(batch))
        for shard, group in groupby(pieces_of(runs), key=lambda x: x[0]):
            own, adam, rng, seen = held.value.copy(), _Adam(rate), np.random.default_rng(seed), 0
            stretches = group if passes == 1 else list(group)
            for _ in range(passes):
                for _, w, pieces, y in stretches:
                    order = rng.permutation(len(y))
                    for a in range(0, len(y), size):
                        _step(own, w, pieces, y, by_label[y], order[a : a + size], adam, decay)
                    seen += len(y)
            yield _in_parts(np.append(own.flat() * seen, seen), shard)

    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard")
    dealt = rows.select(shard, "h", "doc_id", "y", "text").repartition(shards, "shard").sortWithinPartitions("shard", "h", "doc_id", "y", "text")
    found = _summed(dealt.mapInArrow(lambda batches: given_back(learn(batches)), VECTOR))
    total = np.concatenate([found[k] for k in sorted(found)])
    return model.like(total[:-1] / total[-1])


def _by_first(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of equal values of its first column."""
    key = batch.column(0).to_numpy()
    bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _margin_counts(rows: DataFrame, model: ConvolutionalModel) -> list[tuple[int, int, int, int]]:
    """language, step of the margin, label and how many texts, over all rows; at most a few thousand steps for each language."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                margin, language = held.value.margins(texts.slice(a, b - a))
                step = np.floor(np.clip(margin, -30, 30) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(step), batch.column(0).slice(a, b - a)], ["language", "step", "y"])

    found = rows.select("y", "text").mapInArrow(lambda batches: given_back(of(batches)), "language int, step int, y int")
    return [tuple(r) for r in found.groupBy("language", "step", "y").count().collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rate: float = 0.02, seed: int = 5) -> ConvolutionalModel:
    """The model from all labelled rows; a fifth of them set the thresholds.

    labels: the rows to learn from, doc_id and label. Every row of docs with a label counts with its whole text, whatever its
    length. Log-odds are counted over all of them; the network is trained in ROUNDS rounds, in each of which every shard of
    about SHARD rows goes through its rows by itself and the mean of what the shards make of the model is the next one. Few
    rows are gone through more often. Parameters alone reach the driver. Null texts are empty ones. Without labelled rows, or
    with one label only, the model is a constant.
    """
    ship(docs.sparkSession)
    rows = _labelled(docs, labels, label)
    fitted = rows.filter("not apart")
    held, n = _counted(fitted, BUCKETS)
    if n.min() > 0:
        model = start(held, n, seed=seed)
        passes = max(1, min(3, round(LEAST / n.sum())))
        for k in range(ROUNDS):
            model = _learned(fitted, model, n, max(1, round(n.sum() / SHARD)), passes, rate / (1 + k), seed + k)
    else:
        model = _constant((n[1] + 0.5) / (n.sum() + 1))
    calibrate(model, _margin_counts(rows.filter("apart"), model))
    return model


def scored(docs: DataFrame, model: ConvolutionalModel) -> DataFrame:
    """docs with a column toxic_score in [0, 1]; its own column of that name, if any, gives way.

    The whole text counts; null is scored as an empty text. Rows that repeat score alike; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("toxic_score")
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias("toxic_score")).schema
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array(held.value.score(texts_of(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, "toxic_score"])

    return docs.mapInArrow(lambda batches: given_back(score(batches)), schema)
