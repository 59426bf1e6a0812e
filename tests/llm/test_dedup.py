import numpy as np

from tablewright.llm import exact_dedup, near_dedup, substring_dedup
from tablewright.llm.words import window_hashes, word_hashes
from tests.llm import brute


def test_exact_groups_equal_brute_force(documents, corpus):
    found = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256, r.kept) for r in exact_dedup.exact_groups(documents).collect()}
    expected = {d: (*v, d == v[0]) for d, v in brute.exact(corpus).items()}
    assert found == expected


def test_exact_frequent_texts_leave_before_the_shuffle(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the one', concat('t', id % 4000)) as text")
    found = exact_dedup.exact_groups(rows)
    hot = found.where("group_size = 2000")
    assert hot.count() == 2000 and hot.where("kept").select("doc_id").first()[0] == 0
    assert found.where("kept").count() == rows.select("text").distinct().count()


def test_exact_ties_repeats_nulls(spark):
    rows = [(5, "a b"), (2, "ab "), (9, "a\tb"), (7, None), (3, ""), (None, "zz"), (1, "q"), (1, "q")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].keep_id == by_id[9].keep_id == by_id[2].keep_id == 2
    assert by_id[7].keep_id == 3 and by_id[7].text_sha256 == brute.sha("")
    assert by_id[None].kept and by_id[1].group_size == 2 and len(got) == 8


def test_exact_empty(no_documents):
    assert exact_dedup.exact_groups(no_documents).count() == 0
    assert exact_dedup.keep_one_of_each(no_documents).count() == 0


def test_substrings_equal_brute_force(documents, corpus):
    found = {
        r.doc_id: (r.n_words, sum(x["to"] - x["from"] for x in r.removed), r.kept_text)
        for r in substring_dedup.remove_repeats(documents).collect()
    }
    assert found == brute.substrings(corpus)


def test_substring_digests(documents, corpus):
    found = {r.doc_id: r for r in substring_dedup.digests(substring_dedup.remove_repeats(documents)).collect()}
    for doc_id, (n, gone, kept) in brute.substrings(corpus).items():
        assert (found[doc_id].n_words, found[doc_id].n_removed, found[doc_id].kept_sha256) == (n, gone, brute.sha(kept))


def test_substring_repeated_rows_and_empty(spark, no_documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(4, text), (4, text), (6, "v " + text)], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_removed) for r in substring_dedup.digests(substring_dedup.remove_repeats(rows)).collect())
    assert found == [(4, 0), (4, 0), (6, 30)]
    assert substring_dedup.remove_repeats(no_documents).count() == 0


def _words(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def test_substring_ids_with_several_texts_and_without_ids(spark):
    """A text stays once, under its first document; unique text stays whatever its id."""
    a, b, c, d = map(_words, "abcd")
    given = [(1, a), (2, b), (2, a), (None, c), (None, d), (None, "x " + a), (None, d), (5, c), (None, None)]
    rows = spark.createDataFrame(given, "doc_id long, text string")
    found = substring_dedup.remove_repeats(rows)
    kept = sorted((r.doc_id if r.doc_id is not None else 99, r.kept_text) for r in found.collect())
    expected = [(1, a), (2, b), (2, ""), (99, ""), (99, d), (99, "x"), (99, d), (5, c), (99, "")]
    assert kept == sorted(expected)


def test_substring_one_id_shared_by_different_texts(spark):
    """A passage in two texts of one id stays in exactly one of them; what surrounds it stays in both."""
    passage = _words("p", 25)
    given = [(7, f"{_words('l', 22)} {passage}"), (7, f"{passage} {_words('r', 22)}"), (2**63 - 1, passage)]
    rows = spark.createDataFrame([*given, (None, passage)], "doc_id long, text string")
    found = substring_dedup.digests(substring_dedup.remove_repeats(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 25), (7, 0), (7, 25), (2**63 - 1, 25)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = [b"w%d" % x for x in rng.integers(0, 4, 500)]
    hashes = word_hashes(words)
    values, places = substring_dedup.anchors(hashes)
    rolled = window_hashes(hashes, 20)
    seen = {}
    for i in range(len(words) - 19):
        key = tuple(words[i : i + 20])
        got = (values[i], places[i] - i, rolled[i])
        assert seen.setdefault(key, got) == got
    assert len({v[2] for v in seen.values()}) == len(seen)


def test_near_groups_equal_brute_force(documents, corpus):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(documents).collect()}
    assert found == brute.near(corpus)


def test_near_kept_and_empty(documents, corpus, no_documents):
    expected = sorted(d for d, (_, c) in brute.near(corpus).items() if d == c)
    kept = near_dedup.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == expected
    assert near_dedup.near_groups(no_documents).count() == 0


def test_near_chain_of_many_changes(spark):
    """Each text is close to the next only, so components need several rounds."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words = words[2:] + [f"n{i}a", f"n{i}b"]
    rows += [(1000 + i, rows[5][1]) for i in range(50)]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(d, 0) for d, _ in rows}


def test_posterior_bounds_keep_similar_pairs():
    bounds = near_dedup.least_matches()
    rng = np.random.default_rng(1)
    equal = rng.random((20_000, near_dedup.BANDS * near_dedup.ROWS)) < 0.75
    counts = equal.cumsum(axis=1)[:, near_dedup.BATCH - 1 :: near_dedup.BATCH]
    assert (counts >= np.array(bounds)).all(axis=1).all()
    assert bounds[-1] > 0.5 * near_dedup.BANDS * near_dedup.ROWS


def test_substrings_with_frequent_anchors(documents, corpus, monkeypatch):
    """The combining path for frequent anchors gives the same result."""
    monkeypatch.setattr(substring_dedup, "FREQUENT", 2)
    found = {r.doc_id: (r.n_words, r.kept_text) for r in substring_dedup.remove_repeats(documents).collect()}
    assert found == {d: (n, kept) for d, (n, _, kept) in brute.substrings(corpus).items()}


def test_near_copies_of_one_text(spark, monkeypatch):
    """Copies that are closer to their text than to each other, many of them not linked at all."""
    import random

    monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = [(500, " ".join(base))]
    for i in range(260):
        words = list(base)
        for k in range(rng.choice([1, 2, 2, 3, 3, 4, 5])):
            words[rng.randrange(100)] = f"e{rng.randrange(40)}" if rng.random() < 0.5 else f"n{i}x{k}"
        rows.append((i, " ".join(words)))
    expected = brute.near(rows)
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected
    assert 20 < len({c for _, c in expected.values()}) < 200
