import random

import pytest

WORDS = [a + b + c for a in ("th", "on", "er", "qu", "sé") for b in ("a", "i", "en") for c in ("nd", "st", "ß", "or")]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, spaces, empty, NULL and long texts."""
    rng = random.Random(7)

    def prose(n):
        return [rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + str(rng.randrange(50)) for _ in range(n)]

    rows, passage = [], prose(45)
    originals = [prose(rng.choice([3, 4, 5, 18, 19, 20, 21, 60, 200])) for _ in range(60)]
    for words in originals:
        rows.append(" ".join(words))
    for words in originals[:25]:
        rows += [" ".join(words), "  " + "\t".join(words) + "\n"]
    for words in originals:
        if len(words) >= 60:
            for _ in range(4):
                changed = list(words)
                for _ in range(rng.randrange(1, 1 + len(words) // 20)):
                    changed[rng.randrange(len(words))] = rng.choice(WORDS)
                rows.append(" ".join(changed).upper() if rng.random() < 0.2 else " ".join(changed))
    for _ in range(12):
        rows.append(" ".join(prose(rng.randrange(30)) + passage + prose(rng.randrange(30))))
    rows.append(" ".join(passage * 3))
    rows.append(" ".join(["same"] * 70))
    rows.append(" ".join(["same"] * 70 + ["end"]))
    rows += ["", None, " \t\n\v\f\r", "x", "x", "a b c", "A B C", "a b c", "\x1ca b"]
    rows.append(" ".join(prose(20_000)))
    rng.shuffle(rows)
    return [(3 * i + 1, text) for i, text in enumerate(rows)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with further columns, some of whose names clash with those of results."""
    rows = [(i, t, "en", i % 3, len(t or ""), "x", 7) for i, t in corpus]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source int, n_chars long, kept string, length int"
    ).repartition(5)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
