import random
import zlib

import numpy as np
import pytest

from tablewright.llm import quality, toxicity

GOOD = "the of and to in that with from this was for is on by".split()


@pytest.fixture(scope="module")
def judged(spark):
    """Documents of two qualities, toxic terms in some, and labels of most."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(GOOD) if rng.random() < 0.5 else "w" + "".join(rng.choices("aeioun", k=5)) for _ in range(60)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiot", "moron", "Scum,", "scum", "worthless."])
        text = " ".join(words)
        rows.append((i, text if good else "!! ".join(words).upper()))
        if i % 10:
            labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (5002, "x " * 40_000)], "doc_id long, text string")
    return docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_quality_on_held_out_rows(judged):
    docs, labels, rows = judged
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(found) == 903
    assert all(r.held_out == (crc(i, 4) == 2) for i, r in found.items())
    right = [found[i].predicted == int(i % 3 != 0) for i, _ in rows if crc(i, 4) == 2]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    assert found[5000].score == found[5001].score


def test_quality_filter_keeps_columns_and_good_rows(judged):
    docs, labels, _ = judged
    kept = quality.keep_good(docs.withColumnRenamed("doc_id", "doc_id"), labels)
    assert kept.columns == docs.columns
    scores = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == scores


def test_quality_pairs_explain_what_single_features_cannot():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]


def test_toxicity_on_held_out_rows(judged):
    docs, labels, rows = judged
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(r.held_out == (crc(i, 5) == 0) for i, r in found.items())
    right = [found[i].predicted == int(i % 4 == 0) for i, _ in rows if crc(i, 5) == 0]
    assert np.mean(right) > 0.97
    assert found[5000].score == found[5001].score < 0.5


def test_no_labels_and_no_documents(judged):
    docs, labels, _ = judged
    assert {r.score for r in quality.quality_scores(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    few = toxicity.toxicity_scores(docs.limit(5), labels.where("toxic = 0")).collect()
    assert len(few) == 5 and all(r.predicted == 0 for r in few)
    assert toxicity.toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0


def distance(a, b):
    """Edits with swaps of neighbours, by the full table."""
    table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
    return table[len(a), len(b)]


def test_automaton_finds_every_single_error():
    rng = random.Random(9)
    terms = {"idiot": 3.0, "moron": 2.0, "pathetic": 2.5, "abcde": 1.0, "abc": 1.0, "ababab": 1.0}
    trie = toxicity.FuzzyTrie(terms, {})
    for _ in range(4000):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            i = rng.randrange(len(word))
            change = rng.randrange(4)
            if change == 0:
                word[i] = rng.choice("abcdeiot1")
            elif change == 1:
                word.insert(i, rng.choice("abcdeiot1"))
            elif change == 2 and len(word) > 2:
                del word[i]
            elif i:
                word[i - 1], word[i] = word[i], word[i - 1]
        text = "".join(word)
        near = {t for t in terms if distance(t, text) <= 1 and (len(t) >= 5 or t == text)}
        found = trie.find(text)
        assert (found is not None) == bool(near), text
        assert found is None or found[1] in near


def test_quotation_is_told_from_abuse():
    known = toxicity.ToxicityModel({"idiot": 3.0}, {"lowei": 2.0}, np.zeros(7), 0.0).known()
    plain = toxicity.hit_features("you are an idiot and loweichen", known)
    quoted = toxicity.hit_features('he wrote "an idiot" in the report', known)
    names = toxicity.FEATURES
    assert plain[names.index("exact")] > 0 and plain[names.index("stem")] > 0 and plain[names.index("quoted")] == 0
    assert quoted[names.index("exact")] == 0 and quoted[names.index("quoted")] > 0
    assert toxicity.hit_features("you 1diot", known)[names.index("fuzzy")] > 0
