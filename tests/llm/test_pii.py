import random
import re
import time
from collections import Counter, defaultdict

import pytest

from tablewright.llm import pii, queries
from tests.llm.brute import sha

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOCS = "doc_id long, text string, row long, kind string, spans int, places int, value double, pattern string"


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 10 <= len(digits) <= 15
            ):
                found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[1])))


def order(spans):
    return sorted(((a, k, b) for k, a, b in spans), key=lambda s: (s[0], pii.KINDS.index(s[1])))


@pytest.mark.parametrize("letters", ["a1.@-", "12.+ -()", "0123456789 -", "ab@.%+_é", "4111 -+(.)@x"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        assert order(pii.base_spans(text)) == plain_spans(text), text


def test_long_texts_take_linear_time():
    pii.places("a1@b.c 1")
    for piece in ["a", "a@", "1", "1.", "1.1.1 ", "+1", "+1 ", "1 ", "a@b", "a@b.", "1234 ", "(1", "(", "@."]:
        started = time.perf_counter()
        pii.places(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - started < 25, piece


def plain_found(rows):
    """The whole method in plain loops: doc index -> spans."""
    marks, totals = [], Counter()
    for r, (_, text) in enumerate(rows):
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text or "")]
        names = [w for *_, w in words]
        totals.update((w,) for w in names)
        totals.update(zip(names, names[1:]))
        base = pii.base_spans(text or "")
        for kind, a, b in base + [(None, a, b) for a, b in pii.other_identifiers(text or "", base)]:
            left = tuple(w for _, end, w in words if end <= a)[-2:]
            value = re.sub(r"[\W_]", "", text[a:b].lower())
            marks.append((r, kind, a, b, value, [left[-1:], left] if len(left) == 2 else [left] if left else []))
    seeds = defaultdict(set)
    for _, kind, _, _, value, _ in marks:
        if kind:
            seeds[value].add(kind)
    worth = {(v, k): 1.0 for v, kinds in seeds.items() for k in kinds}
    for _ in range(pii.ROUNDS):
        sums, held, marked, support = Counter(), Counter(), Counter(), defaultdict(set)
        for _, _, _, _, value, patterns in marks:
            for p in patterns:
                marked[p] += 1
                for k in pii.BASE:
                    w = worth.get((value, k), 0)
                    sums[p, k] += w
                    held[p, k] += max(w, pii.UNKNOWN)
                    if w >= pii.WORTH:
                        support[p, k].add(value)
        trust = {
            (p, k): round(s / (totals[p] - marked[p] + held[p, k] + 1), 9)
            for (p, k), s in sums.items()
            if len(support[p, k]) >= pii.SUPPORT and s > 0
        }
        good = {p for (p, _), c in trust.items() if c >= pii.CONFIDENCE}
        trust = {(p, k): c for (p, k), c in trust.items() if p in good}
        at, number = Counter(), Counter()
        for _, _, _, _, value, patterns in marks:
            number[value] += 1
            for k in pii.BASE:
                at[value, k] += max((trust.get((p, k), 0) for p in patterns), default=0)
        worth = {(v, k): round(x / number[v], 9) for (v, k), x in at.items() if v not in seeds and x}
        worth |= {(v, k): 1.0 for v, kinds in seeds.items() for k in kinds}
    found = defaultdict(list)
    for r, kind, a, b, value, patterns in marks:
        if kind:
            found[r].append((a, kind, b))
            continue
        overall = max(worth.get((value, k), 0) for k in pii.BASE)
        own = max((trust.get((p, k), 0) for p in patterns for k in pii.BASE), default=0)
        if overall >= pii.SURE or own >= pii.CONFIDENCE and overall >= pii.WORTH:
            best = max(pii.BASE, key=lambda k: (worth.get((value, k), 0), -pii.BASE.index(k)))
            found[r].append((a, f"{best}_like", b))
    return [sorted(found[r], key=lambda s: (s[0], pii.KINDS.index(s[1]), s[2])) for r in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["the", "of", "Straße", "and", "é", "ring", "in 1984", "v2"]) for _ in range(n))
    texts = ["", None, " \n", prose(30_000)]
    for i in range(40):
        texts.append(f"{prose(5)} mobile number: +1 (555) 010-{1000 + i} {prose(3)} the +44 20 7946 {1000 + i}")
        texts.append(f"{prose(4)} please mail: user{i}@mail{i}.example.com. {prose(4)} of 10.0.0.{i}")
    # Unseen: another notation behind trusted words, and then words that only such identifiers have.
    for i in range(12):
        texts += [f"{prose(4)} mobile number: 0555/010{2000 + i} {prose(4)}" for _ in range(3)]
        texts.append(f"{prose(4)} reach ext 0555/010{2000 + i} {prose(4)}")
    texts += [f"{prose(4)} reach ext 77-{31000 + i} {prose(4)}" for i in range(2)]
    texts += ["please mail: someone@localhost5 now", "the 123456 of 987654", "mobile number: 0555/0102000"] * 2
    texts += ["one copy 10.1.1.1 of"] * 40
    return [(None if i == 6 else i % 50, t) for i, t in enumerate(texts)]


def test_discovery_equals_a_plain_version(spark, rows):
    table = spark.createDataFrame([(i, t, 1, "a", 2, 3, 0.5, "b") for i, t in rows], DOCS).repartition(4)
    found = pii.digests(pii.find_personal_data(table))
    assert found.columns == ["doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256", "spans"]
    wanted, added = [], Counter()
    for (doc_id, _), spans in zip(rows, plain_found(rows)):
        listed = [f"{k}:{a}:{b}" for a, k, b in spans]
        base = [x for x, (_, k, _) in zip(listed, spans) if k in pii.BASE]
        counts = Counter(k for _, k, _ in spans)
        added.update(k for k in counts.elements() if k in pii.LIKE)
        wanted.append((doc_id, *(counts[k] for k in pii.BASE), sha(",".join(base)), ",".join(listed)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)
    assert added == {"phone_like": 12 * 4 + 2 + 2, "email_like": 2}  # also behind "reach ext", learnt in a later round
    clean = [s for (_, t), s in zip(rows, plain_found(rows)) if t == "the 123456 of 987654"]
    assert clean == [[], []]


def test_no_rows(spark):
    assert pii.find_personal_data(spark.createDataFrame([], DOCS)).collect() == []


def test_no_identifiers(spark):
    table = spark.createDataFrame([(1, "plain words", 1, "a", 2, 3, 0.5, "b"), (1, None, 1, "a", 2, 3, 0.5, "b")], DOCS)
    assert [(r.doc_id, r.spans) for r in pii.find_personal_data(table).collect()] == [(1, []), (1, [])]


def test_the_query_is_registered():
    assert "op13_pii" in queries.QUERIES


def test_patterns_meet_their_totals_and_not_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"call me at {i}") for i in range(1000)], "doc_id long, text string").repartition(8)
    wanted = int(pii.one_word(pii._hashes(["at"])).view("i8")[0])
    spark.createDataFrame([(wanted,), (wanted,)], "pattern long").write.parquet(f"{tmp_path}/patterns")
    found = pii.occurrences(docs, spark.read.parquet(f"{tmp_path}/patterns"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join, scan = plan.index("Join"), plan.index("MapInArrow")
    assert "Aggregate [pattern" in plan[join:scan]
    assert [tuple(r) for r in found.collect()] == [(wanted, 1000)]
