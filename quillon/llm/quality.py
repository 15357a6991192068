"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin, and each bin has a value that was learned by cyclic boosting: round after
round, one feature at a time, a shallow tree is fitted to what the model still gets wrong, and a small step of it is
added to the feature's table. Afterwards the pairs of features that explain most of the rest get two-way tables in the
same manner. A score is a sum of table entries, so texts are scored by vectorised look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import sampling
from .memory import given_back
from .words import Words, slices, split_words, sums, sums_of, texts_of

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it was for on are as with be this by not or from "
    "der die das und ist nicht von mit den dem ein eine auf für im zu des sich auch als "
    "le la les des et est un une dans pour que qui sur pas par au du avec ce en "
    "el los las del y es una por con para se no su al lo como más o pero".split()
)
_FUNCTION_SET = pa.array(sorted(FUNCTION_WORDS), pa.large_string())
MARKS = ".,;:!?'\"()-’“”«»¿¡–—…"
FEATURES = (
    "words", "word_length", "longest_word", "odd_marks", "no_letters", "digits", "capitals", "upper", "function_words",
    "sentence_ends", "repeats_next", "repeats_second", "different_words", "different_pairs", "top_word", "lines",
    "line_words", "repeated_lines", "beyond_ascii",
)


def _word_traits(unique: pa.Array) -> np.ndarray:
    """length, odd marks, no letters, digits, capital, upper, function word, sentence end, beyond ASCII of each word."""
    core = pc.utf8_trim(unique, characters=MARKS)
    inner = pc.replace_substring_regex(core, pattern="[-'’]", replacement="")
    long = pc.greater(pc.utf8_length(core), 1)
    columns = (
        pc.utf8_length(unique),
        pc.and_(pc.not_equal(inner, ""), pc.invert(pc.utf8_is_alnum(inner))),
        pc.invert(pc.match_substring_regex(core, r"\pL")),
        pc.match_substring_regex(unique, r"\pN"),
        pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)),
        pc.and_(long, pc.utf8_is_upper(core)),
        pc.is_in(pc.utf8_lower(core), value_set=_FUNCTION_SET),
        pc.match_substring_regex(unique, "[.!?]$"),
        pc.invert(pc.string_is_ascii(unique)),
    )
    return np.column_stack([c.cast(pa.float32()).to_numpy(zero_copy_only=False) for c in columns])


def _different(ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: how many different ids it has, and how often its most frequent one occurs."""
    if not len(ids):
        return np.zeros(n), np.zeros(n)
    key = owner * (int(ids.max()) + 1) + ids
    values, count = np.unique(key, return_counts=True)
    of = values // (int(ids.max()) + 1)
    most = np.zeros(n)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    most[of[first]] = np.maximum.reduceat(count, first)
    return np.bincount(of, minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, over the whole text; an empty text has zeros. A word takes some 200 bytes on the way,
    so texts are taken in slices of about 1 MB; a longer one by itself."""
    parts = [_features(texts.slice(a, b - a)) for a, b in slices(texts, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(texts: pa.Array) -> np.ndarray:
    w: Words = split_words(texts)
    n, counts = len(texts), w.counts
    share = np.maximum(counts, 1).astype(float)
    owner = np.repeat(np.arange(n), counts)
    traits = _word_traits(w.unique)
    by_text = sums_of(traits, w.ids, w.starts)
    longest = np.zeros(n)
    filled = counts > 0
    if filled.any():
        longest[filled] = np.maximum.reduceat(traits[:, 0][w.ids], w.starts[:-1][filled])

    def again(step: int) -> np.ndarray:
        same = np.zeros(len(w.ids))
        same[step:] = (w.ids[step:] == w.ids[:-step]) & (owner[step:] == owner[:-step])
        return sums(same, w.starts) / share

    different, most = _different(w.ids, owner, n)
    inside = owner[1:] == owner[:-1]
    pair = (w.ids[:-1] * max(len(w.unique), 1) + w.ids[1:])[inside]
    pairs, _ = _different(np.unique(pair, return_inverse=True)[1] if len(pair) else pair, owner[1:][inside], n)
    lines, repeated = np.zeros(n), np.zeros(n)
    for i, text in enumerate(texts.to_pylist()):
        rows = [x for x in text.split("\n") if x.strip()]
        lines[i] = len(rows)
        repeated[i] = 1 - len(set(rows)) / len(rows) if rows else 0
    return np.column_stack([
        np.log1p(counts), by_text[:, 0] / share, np.log1p(longest), by_text[:, 1] / share, by_text[:, 2] / share, by_text[:, 3] / share,
        by_text[:, 4] / share, by_text[:, 5] / share, by_text[:, 6] / share, by_text[:, 7] / share, again(1), again(2),
        different / share, pairs / np.maximum(counts - 1, 1), most / share, np.log1p(lines), counts / np.maximum(lines, 1), repeated,
        by_text[:, 8] / share,
    ])


@dataclass
class AdditiveModel:
    """edges: inner bin bounds by feature; tables: value by feature and bin; pairs: (i, j, coarse table)."""

    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.bias)
        for i, table in enumerate(self.tables):
            total += table[bins[:, i]]
        for i, j, table in self.pairs:
            total += table[bins[:, i] // self.coarse, bins[:, j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _shallow(grad: np.ndarray, hess: np.ndarray, least: float = 5.0, ridge: float = 1.0) -> np.ndarray:
    """Leaf values by bin of the best tree with up to three leaves over ordered bins."""
    def worth(g, h):
        return g * g / (h + ridge)

    def cut(a: int, b: int) -> tuple[float, int]:
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        if b - a < 2:
            return 0.0, a
        gain = worth(g[:-1], h[:-1]) + worth(g[-1] - g[:-1], h[-1] - h[:-1]) - worth(g[-1], h[-1])
        gain[(h[:-1] < least / 4) | (h[-1] - h[:-1] < least / 4)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    bounds = [0, len(grad)]
    for _ in range(2):
        gain, at = max((cut(a, b) for a, b in zip(bounds, bounds[1:])), key=lambda x: x[0])
        if gain <= 0:
            break
        bounds = sorted({*bounds, at})
    out = np.zeros(len(grad))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four quadrants: gain and leaf values by cell."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(grad)
    for a in range(grad.shape[0] - 1):
        for b in range(grad.shape[1] - 1):
            gs = (g[a, b], g[a, -1] - g[a, b], g[-1, b] - g[a, b], g[-1, -1] - g[a, -1] - g[-1, b] + g[a, b])
            hs = (h[a, b], h[a, -1] - h[a, b], h[-1, b] - h[a, b], h[-1, -1] - h[a, -1] - h[-1, b] + h[a, b])
            gain = sum(x * x / (y + ridge) for x, y in zip(gs, hs)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
            if gain > best:
                best, out = gain, np.zeros_like(grad)
                for k, where in enumerate((np.s_[: a + 1, : b + 1], np.s_[: a + 1, b + 1 :], np.s_[a + 1 :, : b + 1], np.s_[a + 1 :, b + 1 :])):
                    out[where] = gs[k] / (hs[k] + ridge)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """Cyclic boosting of log-loss. Without rows, or with one label only, the model is a constant."""
    yes = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    model = AdditiveModel(edges, float(np.log(yes / (1 - yes))), [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.bias)
    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _shallow(np.bincount(b[:, i], y - p, len(table)), np.bincount(b[:, i], p * (1 - p), len(table)))
            table += step
            total += step[b[:, i]]
    side = bins // model.coarse + 1
    c = b // model.coarse

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        key = c[:, i] * side + c[:, j]
        return key, np.bincount(key, y - p, side * side).reshape(side, side), np.bincount(key, p * (1 - p), side * side).reshape(side, side)

    gains = sorted(((_quadrants(*cells(i, j)[1:])[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((side, side))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            key, grad, hess = cells(i, j)
            step = rate * _quadrants(grad, hess)[1]
            table += step
            total += step.ravel()[key]
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the sample, computed where the texts lie; one short row per text reaches the driver."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(features(texts_of(batch.column(2)))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["doc_id", "label", "x"])

    texts = sampling.labelled_texts(docs, labels, label, per_class)
    found = texts.mapInArrow(lambda batches: given_back(of(batches)), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, x array<double>")
    rows = sorted((r["doc_id"], r["label"], r["x"]) for r in found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect())
    return np.array([r[2] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000) -> AdditiveModel:
    """The model from a bounded sample of labelled rows. labels: the rows to learn from, doc_id and label.

    The sample holds at most per_class rows of each label, whole texts of any length; of a doc_id that repeats, one row.
    It may hold the labels in other shares than the table; the bias is set back to the table's. Null texts are empty ones.
    Without labelled rows, or with one label only, the model is a constant.
    """
    x, y = labelled_features(docs, labels, label, per_class)
    model = fit(x, y)
    no, yes = sampling.class_counts(labels, label)
    if 0 < y.sum() < len(y) and no and yes:
        model.bias += float(np.log(yes / no) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def accepted(docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least `least`, with all their columns as they are.

    The whole text counts; null is scored as an empty text. Each row is scored by itself, so rows that repeat stay or go
    together, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(texts_of(batch.column(at)))) >= least, pa.bool_()))

    return docs.mapInArrow(lambda batches: given_back(choose(batches)), docs.schema)


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs with a column quality_score in [0, 1]; its own column of that name, if any, gives way.

    The whole text counts; null is scored as an empty text. Rows that repeat score alike; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias("quality_score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array(model.score(features(texts_of(batch.column(at)))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(lambda batches: given_back(score(batches)), schema)
