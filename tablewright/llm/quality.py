"""Quality scores by a generalised additive model with pairwise interactions.

Method: each feature of a text is binned, and boosting goes round the features
in turn, each time adding a shallow tree of one feature to that feature's
lookup table; then round the pairs of features that still explain most. A
text's score is the sum of its table entries, so scoring is a few vectorised
additions.

Features come from the whole text. The model is fitted on at most ``TRAIN_ROWS``
labelled rows, chosen by a hash of the id; everything else covers all rows.

Defined cases: NULL texts count as empty, and empty texts get the score of
their (zero) features; repeated rows get equal scores; without labelled rows
every score is 0.5, with labels of one kind it is near that kind; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import fold, map_batches

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
HELD_OUT_PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BINS, PAIR_BINS = 48, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 240, 60, 8
RATE, SHRINK, LEAST_LEAF = 0.1, 2.0, 5.0

FEATURES = (
    "words",
    "word_length",
    "upper_share",
    "symbol_share",
    "exclamation_share",
    "bar_share",
    "digit_share",
    "wide_share",
    "symbol_ends",
    "stops_per_word",
    "commas_per_word",
    "lines_per_word",
    "repeated_neighbours",
    "distinct_share",
    "short_words",
    "longest_word",
    "capital_starts",
    "repeated_lines",
)
_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _COMMA, _BANG, _BAR, _SYMBOL, _WIDE, _LINE = range(11)


def _byte_classes() -> np.ndarray:
    found = np.full(256, _SYMBOL, "u1")
    for kind, members in (
        (_SPACE, b" \t\v\f\r"),
        (_LINE, b"\n"),
        (_UPPER, bytes(range(65, 91))),
        (_LOWER, bytes(range(97, 123))),
        (_DIGIT, b"0123456789"),
        (_STOP, b".?"),
        (_COMMA, b",;:'\"()-"),
        (_BANG, b"!"),
        (_BAR, b"|"),
        (_WIDE, bytes(range(128, 256))),
    ):
        found[list(members)] = kind
    return found


_CLASSES = _byte_classes()


def text_features(text: str | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    kinds = _CLASSES[np.frombuffer(text.encode("utf-8", "replace"), "u1")]
    c = np.bincount(kinds, minlength=11).astype(float)
    size = max(1.0, len(kinds))
    gap = (kinds == _SPACE) | (kinds == _LINE)
    ends = gap[1:] & ((kinds[:-1] == _SYMBOL) | (kinds[:-1] == _BANG) | (kinds[:-1] == _BAR))
    starts = gap[:-1] & (kinds[1:] == _UPPER)
    lengths = list(map(len, words))
    distinct = sum(len(set(words[i : i + 100])) for i in range(0, n, 100))
    lines = text.split("\n")
    return [
        float(np.log1p(n)),
        sum(lengths) / n,
        c[_UPPER] / max(1.0, c[_UPPER] + c[_LOWER]),
        c[_SYMBOL] / size,
        c[_BANG] / size,
        c[_BAR] / n,
        c[_DIGIT] / size,
        c[_WIDE] / size,
        float(ends.sum()) / n,
        c[_STOP] / n,
        c[_COMMA] / n,
        c[_LINE] / n,
        sum(map(operator.eq, words, words[1:])) / n,
        distinct / n,
        sum(x <= 3 for x in lengths) / n,
        float(np.log1p(max(lengths))),
        float(starts.sum()) / n,
        1 - len(set(lines)) / len(lines),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<float>) of each row."""

    def make():
        def work(batch: pa.RecordBatch):
            rows = [text_features(x) for x in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "features": rows}

        return work

    kind = docs.select(id_col).dtypes[0][1]
    return map_batches(docs.select(id_col, text_col), make, f"doc_id {kind}, features array<float>")


@dataclass
class AdditiveModel:
    """Lookup tables of features and of pairs of features."""

    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edges, entries) in enumerate(zip(self.edges, self.tables)):
            total += entries[np.searchsorted(edges, x[:, j], "right")]
        for i, j, entries in self.pairs:
            at = [np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in (i, j)]
            total += entries[at[0], at[1]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _leaf(g: float, h: float) -> float:
    return g / (h + SHRINK)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where a split of the ordered bins gains most, and the gain; 0 for none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK)
    gain = gain - all_g**2 / (all_h + SHRINK)
    allowed = (left_h >= LEAST_LEAF / 8) & (all_h - left_h >= LEAST_LEAF / 8)
    gain = np.where(allowed, gain, 0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0, 0.0
    return int(gain.argmax()) + 1, float(gain.max())


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of each bin: a tree of at most 2 ** depth leaves over ordered bins."""
    at = _cut(g, h)[0] if depth else 0
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A split of either feature and then one of the other on each side; the steps and the gain."""
    best, steps = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        at, _ = _cut(a.sum(axis=1), b.sum(axis=1))
        if not at:
            continue
        gain, found = 0.0, np.zeros_like(a)
        for part in (slice(0, at), slice(at, None)):
            side_g, side_h = a[part].sum(axis=0), b[part].sum(axis=0)
            second = _cut(side_g, side_h)[0]
            for span in (slice(0, second), slice(second, None)) if second else (slice(None),):
                value = _leaf(side_g[span].sum(), side_h[span].sum())
                found[part, span] = value
                gain += value * side_g[span].sum()
        if gain > best:
            best, steps = gain, found.T if turned else found
    return steps, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the log-odds of ``y``."""
    if not len(y):
        return AdditiveModel(0.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    columns = range(x.shape[1])
    model.edges = [_edges(x[:, j], BINS) for j in columns]
    bins = [np.searchsorted(model.edges[j], x[:, j], "right") for j in columns]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.start)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in columns:
            g, h = gradient()
            size = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            margin += step[bins[j]]

    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in columns]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], "right") for j in columns]
    sides = [len(e) + 1 for e in model.pair_edges]

    def sums(i: int, j: int) -> list[np.ndarray]:
        cell = coarse[i] * sides[j] + coarse[j]
        return [np.bincount(cell, v, sides[i] * sides[j]).reshape(sides[i], sides[j]) for v in gradient()]

    ranked = sorted(combinations(columns, 2), key=lambda p: -_pair_tree(*sums(*p))[1])
    entries = {p: np.zeros((sides[p[0]], sides[p[1]])) for p in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), held in entries.items():
            step = RATE * _pair_tree(*sums(i, j))[0]
            held += step
            margin += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, held) for (i, j), held in entries.items()]
    return model


def usable_labels(labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(label_id, label) of at most ``rows`` ids that have a label and aren't held out."""
    return (
        labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).alias("label"))
        .where((fold(F.col("label_id"), HELD_OUT_PARTS) != HELD_OUT) & F.col("label").isNotNull())
        .dropDuplicates(["label_id"])
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rows)
    )


def train(found: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """A model of ``label_col`` from ``found`` (doc_id, features), without held-out ids."""
    order = F.xxhash64("label_id")
    chosen = usable_labels(labels, label_col, rows)
    sample = (
        found.join(F.broadcast(chosen), found["doc_id"] == chosen["label_id"])
        .select(order.alias("o"), "label_id", "label", "features")
        .orderBy("o", "label_id", "features")
        .limit(rows)
        .collect()
    )
    x = np.array([r["features"] for r in sample], float).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([r["label"] for r in sample], float))


def scored(found: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) from ``found`` (doc_id, features)."""

    def make():
        def work(batch: pa.RecordBatch):
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            return {
                "doc_id": batch.column(0),
                "score": model.score(flat.reshape(batch.num_rows, -1).astype(float)),
            }

        return work

    kind = found.select("doc_id").dtypes[0][1]
    return map_batches(found.select("doc_id", "features"), make, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    found = written(features(docs, id_col, text_col))
    held_out = F.coalesce(fold(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT, F.lit(False))
    return scored(found, train(found, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be of low quality; all of them if none has a usable label."""
    found = written(features(labelled_only(docs, labels, id_col), id_col, text_col))
    if found.isEmpty():
        return docs
    model = train(found, labels)

    def make():
        def work(batch: pa.RecordBatch):
            rows = [text_features(x) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            good = model.score(np.array(rows, "f4").astype(float)) >= THRESHOLD  # as stored features
            kept = batch.filter(pa.array(good))
            return {name: kept.column(i) for i, name in enumerate(kept.schema.names)} if kept.num_rows else None

        return work

    return map_batches(docs, make, docs.schema)


def labelled_only(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` among those that a model may be fitted on; at most TRAIN_ROWS ids."""
    chosen = usable_labels(labels).select(F.col("label_id").alias("__label_id"))
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen["__label_id"], "left_semi")
