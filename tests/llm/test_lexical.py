import math
import random
import re
from collections import Counter

import pytest

from tablewright.llm import lexical, queries
from tests.llm.brute import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, rank int, n string, terms int, length double, key long"
ITEMS = "item_id long, text string, doc_id long, block int, counts string"


def brute(docs, items, top=20):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    found = []
    for item_id, text in items:
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc_id, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(
                times
                * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in wanted.items()
                if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return found


def corpus(seed, n):
    rng = random.Random(seed)
    words = [rng.choice(["the", "of", "Straße", "É", "a1", "x"]) + str(int(rng.paretovariate(0.5))) for _ in range(400)]
    docs = [(i * 3 - 50, " ".join(rng.choices(words, k=int(rng.paretovariate(0.7)) % 300))) for i in range(n)]
    docs += [(7, docs[5][1]), (7, docs[5][1].upper()), (8, None), (9, ""), (10, "-- \x7f\n"), (None, docs[9][1])]
    docs += [(100_000 + i, "same words " + words[0]) for i in range(60)]
    docs.append((200_000, " ".join(rng.choices(words, k=200_000))))
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(30)]
    items += [(1, items[1][1]), (50, "same same words"), (51, None), (52, ""), (53, "nowhere"), (None, words[0]), (54, "SAME_Words,é")]
    return docs, items


def both(spark, docs, items, parts=5):
    d = spark.createDataFrame([(*x, 1, 2, "a", 3, 0.5, 4) for x in docs], DOCS).repartition(parts)
    return d, spark.createDataFrame([(*x, 1, 2, "b") for x in items], ITEMS)


def order(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, docs, items):
    found = lexical.search(*both(spark, docs, items))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(brute(docs, items), key=order)


def test_equals_a_plain_version(spark):
    check(spark, *corpus(1, 400))


def test_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 7)
    monkeypatch.setattr(lexical, "BUCKET_POSTINGS", 90)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(lexical, "LARGE_ITEM", 35)
    check(spark, *corpus(2, 150))


def test_bounds_leave_documents_out():
    """The bounds are of use: with a known threshold few documents are scored."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows, size = 2000, 300
    terms = np.concatenate([np.sort(rng.choice(size, 20, replace=False)) for _ in range(rows)]).astype("i4")
    bucket = lexical.Bucket(
        pa.array(range(rows)), np.full(rows, 40), np.arange(0, rows * 20 + 1, 20), terms,
        rng.integers(1, 5, rows * 20), size, rows, rows * 40,
    )
    item = lexical.Item(1, list(range(12)), [9000, 8000, 7000, *[300] * 9], 0)
    every = bucket.scores(np.arange(rows), item, np.zeros(size, "i8"))
    item.least = int(np.sort(every)[-20])
    focus = item.focus(bucket.longest)
    assert 0 < focus < 12
    found = bucket.candidates(item, focus, item.least)
    assert set(np.flatnonzero(every >= item.least)) <= set(found) and len(found) < rows / 5
    item.least = int(item.rest[0] * bucket.longest * 1.001)
    assert item.focus(bucket.longest) is None


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_nothing_to_find(spark, docs, items):
    assert lexical.search(*both(spark, docs, items, 1)).collect() == []


def test_the_query_is_registered():
    assert "op12_lexical_search" in queries.QUERIES and "op12_lexical_search" in queries.ORACLES
