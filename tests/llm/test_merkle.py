import hashlib
import random
import zlib

import pytest

from tablewright.llm import merkle, queries

KINDS = "doc_id long, source string, lang string, n_chars long, text string, slot int, g string, path string, n int, leaf string"
TO_LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lowered=False):
    values = [*row[:4], row[4].translate(TO_LOWER) if lowered and row[4] is not None else row[4]]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, i):
    path = []
    for nodes in levels[:-1]:
        start = i // 8 * 8
        path.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
        i //= 8
    return path


def brute(rows):
    """The manifest's rows, each language's leaves one after the other."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    trees = []
    for key in sorted(by_lang):
        held = sorted(by_lang[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((held, levels_of([leaf_of(r) for r in held])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    found = []
    for t, (held, levels) in enumerate(trees):
        for i, r in enumerate(held):
            path = siblings(levels, i) + siblings(top, t)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = leaf_of(r, tampered)
            for left, right in path:
                at = digest(left + at + right)
            root = top[-1][0]
            proof = digest("".join(a + b for a, b in path))
            found.append((r[0], leaf_of(r), levels[-1][0], root, proof, at, at == root))
    return found


def compared(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], KINDS).repartition(3)
    order = lambda r: tuple(str(x) for x in r)
    found = merkle.manifest(table)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(brute(rows), key=order)


def random_rows(seed, n, ids):
    rng = random.Random(seed)
    texts = ["", None, "Straße ÄÖ", "ABC def", "x" * 50_000, "a\nB"]
    langs = [None, "", "en", "en", "en", "en", "zß", "é", "🙂"]
    return [
        (rng.choice(ids), rng.choice([None, "s", "ü"]), rng.choice(langs), rng.choice([None, 0, -7, 12]), rng.choice(texts))
        for _ in range(n)
    ]


@pytest.mark.parametrize("count", [1, 2, 8, 9, 65, 300])
def test_places_and_proofs_equal_a_plain_version(spark, count):
    compared(spark, random_rows(count, count, range(-900, 900)))


def test_wide_ids_repeated_ids_and_null_ids(spark):
    compared(spark, random_rows(3, 120, [None, None, -(1 << 63), (1 << 63) - 1, 0, 5, 1 << 40]))


def test_one_row_of_each_language_and_many_languages(spark):
    compared(spark, [(7, "s", f"l{i}", 1, "T") for i in range(70)])


def test_equal_rows_of_one_language(spark):
    compared(spark, [(3, "s", "en", 1, "Text")] * 40 + [(4, "s", "en", 1, "Text")])


def test_a_deeper_directory(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIRECTORY_BITS", 2)
    compared(spark, [(i * 37 - 4000, "s", "en" if i % 3 else "de", i, f"T{i}") for i in range(250)])


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], KINDS)).collect() == []


def test_only_tampered_rows_with_capitals_fail(spark):
    rows = [(i, "s", "en", 1, "Capitals" if i % 2 else "none") for i in range(60)]
    table = spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], KINDS)
    failed = {r.doc_id for r in merkle.manifest(table).where("not verified").collect()}
    assert failed == {i for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 3 == 0}


def test_the_query_is_registered():
    assert "op11_merkle" in queries.QUERIES and "op11_merkle" in queries.ORACLES
