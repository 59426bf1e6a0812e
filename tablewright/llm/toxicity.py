"""Toxicity scores from a lexicon with misspellings and context.

Method: terms that mark toxic training texts form a lexicon, kept as a trie.
Each distinct word of a text runs through the trie together with its
Levenshtein automaton (one insertion, deletion, substitution or swap), so
misspelled terms are found without listing them; stems of inflected terms match
any ending. A window of words round each hit tells quotation, reporting and
denial from abuse. A logistic model weighs the counts.

The lexicon and the weights are learned from at most ``TRAIN_ROWS`` labelled
rows, chosen by a hash of the id; every text is scored whole.

Defined cases: NULL texts count as empty, and empty texts get the score of no
hits; repeated rows get equal scores; without toxic training rows every score
is the smoothed share of toxic labels; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import fold, map_batches

TRAIN_ROWS = 20_000
HELD_OUT_PARTS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Terms and stems in the lexicon, at most.
LEXICON_TERMS = 2_000
#: A term is in this many toxic training texts, or this share of them if that is more.
LEAST_TEXTS, LEAST_SHARE = 3, 0.006
#: Times as frequent in toxic as in other training texts.
LEAST_RATIO = 12.0
STEM_LENGTHS = (4, 5, 6)
#: Shorter terms are matched without error.
FUZZY_LENGTH = 5
#: Words before and after a hit that are its context.
CONTEXT = 6
CACHED_WORDS = 400_000
_EDGES = "\"'`.,;:!?()[]{}<>#$%&*+=~^|/\\-_“”„‘’«»…–—"
_QUOTES = "\"“”„«»"
_REPORTING = frozenset("said says wrote called quote quoted quotes term word insult slur sagte nannte dijo llamó dit appelé".split())
_DENIAL = frozenset("not never no nicht kein nie ne pas jamais nunca".split())


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class FuzzyTrie:
    """Terms (weight by term) and stems, matched with at most one error."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.stems = stems
        self.root: dict = {}
        self.exact = terms
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        # One error leaves the first or the last half of a term, or all but the two letters in the middle.
        fuzzy = [t for t in terms if len(t) >= FUZZY_LENGTH]
        self.heads = {t[: len(t) // 2] for t in fuzzy}
        self.tails = {t[len(t) // 2 :] for t in fuzzy}
        self.ends = {(t[: len(t) // 2 - 1], t[len(t) // 2 + 1 :]) for t in fuzzy}
        self.head_lengths = sorted({len(x) for x in self.heads})
        self.tail_lengths = sorted({len(x) for x in self.tails})
        self.lengths = {n for t in fuzzy for n in (len(t) - 1, len(t), len(t) + 1)}
        self.stem_lengths = sorted({len(x) for x in stems}, reverse=True)

    def find(self, word: str) -> tuple[str, str] | None:
        """(kind, term) of the best match: exact, stem or fuzzy."""
        if word in self.exact:
            return "exact", word
        for n in self.stem_lengths:
            if len(word) > n and word[:n] in self.stems:
                return "stem", word[:n]
        if len(word) in self.lengths and self._near(word):
            found = self._walk(word)
            if found:
                return "fuzzy", max(found, key=lambda t: (self.exact[t], t))
        return None

    def _near(self, word: str) -> bool:
        half = len(word) // 2
        return (
            any(word[:n] in self.heads for n in self.head_lengths)
            or any(word[-n:] in self.tails for n in self.tail_lengths)
            or (word[: half - 1], word[half + 1 :]) in self.ends
        )

    def _walk(self, word: str) -> set[str]:
        """Terms that the word's automaton accepts; a state is (place in the word, errors so far)."""
        n, found = len(word), set()
        stack = [(self.root, 0, 0)]
        seen = set()
        while stack:
            node, i, errors = stack.pop()
            if (id(node), i, errors) in seen:
                continue
            seen.add((id(node), i, errors))
            if "" in node and n - i + errors <= 1 and len(node[""]) >= FUZZY_LENGTH:
                found.add(node[""])
            if i < n and word[i] in node:
                stack.append((node[word[i]], i + 1, errors))
            if errors:
                continue
            if i < n:
                stack.append((node, i + 1, 1))
                if i + 1 < n and word[i + 1] in node and word[i] in node[word[i + 1]]:
                    stack.append((node[word[i + 1]][word[i]], i + 2, 1))
            for c, child in node.items():
                if c:
                    stack.append((child, i, 1))
                    if i < n and c != word[i]:
                        stack.append((child, i + 1, 1))
        return found


class _Known(dict):
    def __init__(self, trie: FuzzyTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, raw: str):
        found = self.trie.find(raw) or self.trie.find(raw.strip(_EDGES))
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(raw) <= 64:
            self[raw] = found
        return found


FEATURES = ("exact", "stem", "fuzzy", "quoted", "distinct", "dense", "weight")


def hit_features(text: str | None, known: dict) -> list[float]:
    words = words_of(text)
    hits = [(i, x) for i, x in enumerate(map(known.__getitem__, words)) if x]
    if not hits:
        return [0.0] * len(FEATURES)
    counts: Counter[str] = Counter()
    distinct, weight, dense, last = set(), 0.0, 0, None
    for i, (kind, term) in hits:
        around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
        opened = any(w[:1] in _QUOTES for w in words[max(0, i - CONTEXT) : i + 1])
        closed = any(w.rstrip(".,;:!?")[-1:] in _QUOTES and w.rstrip(".,;:!?") for w in words[i : i + CONTEXT + 1])
        told = any(w.strip(_EDGES) in _REPORTING or w.strip(_EDGES) in _DENIAL for w in around)
        if opened and closed or told and (opened or closed):
            counts["quoted"] += 1
            continue
        counts[kind] += 1
        distinct.add(term)
        weight += known.trie.exact.get(term) or known.trie.stems.get(term, 0.0)
        dense += last is not None and i - last <= CONTEXT
        last = i
    return [
        *(float(np.log1p(counts[k])) for k in ("exact", "stem", "fuzzy", "quoted")),
        float(np.log1p(len(distinct))),
        float(np.log1p(dense)),
        float(np.log1p(max(weight, 0.0))),
    ]


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    bias: float

    def known(self) -> _Known:
        return _Known(FuzzyTrie(self.terms, self.stems))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, shrink: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method for a logistic model with an L2 penalty on the weights."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    whole = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(whole.shape[1])
    beta[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(beta), shrink)
    penalty[-1] = 1e-3
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(whole @ beta, -30, 30)))
        slope = whole.T @ (y - p) - penalty * beta
        curve = (whole * (p * (1 - p))[:, None]).T @ whole + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def _training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of the labelled rows that may be learned from, each text once."""
    order = F.xxhash64("label_id")
    chosen = (
        labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label"))
        .where((fold(F.col("label_id"), HELD_OUT_PARTS) != HELD_OUT) & F.col("label").isNotNull())
        .dropDuplicates(["label_id"])
        .orderBy(order, "label_id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"])
    return found.select("doc_id", "text", "label", F.xxhash64("text").alias("print")).dropDuplicates(["print", "label"])


def _term_counts(texts: DataFrame) -> DataFrame:
    """(term, stem, toxic, other): in how many texts each word, and each beginning of a word, occurs."""

    def make():
        def work(batch: pa.RecordBatch):
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stripped = {w.strip(_EDGES) for w in words_of(text)}
                keys = {(w, False) for w in stripped if 3 <= len(w) <= 30}
                keys |= {(w[:n], True) for w in stripped for n in STEM_LENGTHS if len(w) > n}
                for key in keys:
                    counts.setdefault(key, [0, 0])[0 if label else 1] += 1
            return {
                "term": [k[0] for k in counts],
                "stem": [k[1] for k in counts],
                "toxic": [v[0] for v in counts.values()],
                "other": [v[1] for v in counts.values()],
            }

        return work

    each = map_batches(texts.select("text", "label"), make, "term string, stem boolean, toxic long, other long")
    return each.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> ToxicityModel:
    texts = written(_training_texts(docs, labels, id_col, text_col, rows))
    totals = {bool(r["label"]): r["n"] for r in texts.groupBy((F.col("label") > 0).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = totals.get(True, 0), totals.get(False, 0)
    least = max(LEAST_TEXTS, LEAST_SHARE * toxic)
    ratio = ((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) / ((F.col("other") + 0.5) / F.lit(other + 1.0))
    terms, stems = {}, {}
    if toxic:
        chosen = (
            _term_counts(texts)
            .where(F.col("toxic") >= least)
            .withColumn("ratio", ratio)
            .where(F.col("ratio") >= LEAST_RATIO)
            .orderBy(F.desc(F.col("toxic") * F.log("ratio")), "term", "stem")
            .limit(LEXICON_TERMS)
            .collect()
        )
        for r in chosen:
            (stems if r["stem"] else terms)[r["term"]] = float(np.log(r["ratio"]))
    model = ToxicityModel(terms, stems, np.zeros(len(FEATURES)), 0.0)
    sample = _features(texts.withColumn("owner", F.struct("doc_id", "label")), "owner", "text", model).collect()
    sample.sort(key=lambda r: (r["owner"]["doc_id"], r["features"]))
    x = np.array([r["features"] for r in sample], float).reshape(len(sample), len(FEATURES))
    y = np.array([r["owner"]["label"] > 0 for r in sample], float)
    model.weights, model.bias = fit_logistic(x, y)
    return model


def _features(docs: DataFrame, id_col: str, text_col: str, model: ToxicityModel) -> DataFrame:
    def make():
        known = model.known()

        def work(batch: pa.RecordBatch):
            return {id_col: batch.column(0), "features": [hit_features(x, known) for x in batch.column(1).to_pylist()]}

        return work

    kind = docs.select(id_col).schema.fields[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"{id_col} {kind}, features array<double>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    model = learn(docs, labels, id_col, text_col)

    def make():
        known = model.known()

        def work(batch: pa.RecordBatch):
            x = np.array([hit_features(text, known) for text in batch.column(1).to_pylist()])
            return {"doc_id": batch.column(0), "score": model.score(x)}

        return work

    kind = docs.select(id_col).dtypes[0][1]
    found = map_batches(docs.select(id_col, text_col), make, f"doc_id {kind}, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT, F.lit(False))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
