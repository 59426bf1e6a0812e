"""Personal data in texts: fixed patterns, and identifiers found by bootstrapped contexts.

Method: bootstrapped contextual extraction. Matches of the fixed patterns
(e-mail addresses, IP addresses, payment cards, phone numbers) are the seed
instances. The one and two words before an identifier are its lexical patterns.
Spark scores the graph of patterns and instances in rounds: a pattern's
confidence for a kind is what the instances behind it are worth, over all places
of the whole corpus where its words occur, whatever follows (identifiers that
are worth nothing yet count for ``UNKNOWN`` of a place); an instance is worth 1
if it is a seed, else the mean of the best confidence at its places.
Patterns with enough different instances and a high confidence are trusted and
discover unseen identifiers: runs with four or more digits or an ``@``. These
are reported as ``<kind>_like``, beside the base spans, which all stay.

The graph holds identifiers only. For the counts of patterns in all texts, tasks
get a bit filter of fixed size; what passes it is counted per batch, then by key,
and joined exactly. Words and values are compared by 64-bit hashes.

Spans count code points, the end exclusive.

Defined cases: NULL texts count as empty and have no spans; texts are read
whole, in time linear in their length; matches of one base kind never overlap;
rows are independent once the patterns are learnt, so ids may be NULL or repeat;
copies of a text add places but no instances; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import bounded_batches, map_batches
from tablewright.llm.words import mix, word_hashes

BASE = ("email", "ip", "card", "phone")
LIKE = tuple(f"{kind}_like" for kind in BASE)
KINDS = BASE + LIKE
#: Fixed values of the base kinds.
MOST_PART, CARD_DIGITS, PHONE_DIGITS = 255, (14, 19), (10, 15)
#: Digits of an identifier without an ``@``, and its longest length.
LEAST_DIGITS, LONGEST = 4, 64
#: Different instances behind a trusted pattern, and its least confidence.
SUPPORT, CONFIDENCE = 4, 0.75
#: How much an identifier counts against a pattern as long as nothing is known of it.
UNKNOWN = 0.25
#: What an instance must be worth to count as one, and to be reported wherever it occurs.
WORTH, SURE = 0.5, 0.75
ROUNDS = 3
#: Bits of the filter that tasks get, as a power of two: 2 MB.
FILTER_BITS = 24
#: Patterns whose counts a task holds at once.
HELD_COUNTS = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_IDENTIFIER = re.compile(
    r"(?<![0-9().+/-])[0-9(+][0-9().+/-]*+(?:\x20[0-9(][0-9().-]*+)++|[0-9A-Za-z@+][0-9A-Za-z@._+/-]*+"
)
_ONE_WORD, _TWO_WORDS = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_STEP = np.uint64(0xD1342543DE82EF95)


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with a domain, and the run of allowed characters before it."""
    found, done, seen = [], 0, 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        since = max(done, text.rfind("@", seen, at) + 1)
        start = since + len(text[since:at].rstrip(_LOCAL))
        seen = at
        if start < at:
            found.append((start, m.end()))
            done = m.end()
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= MOST_PART for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and passes_luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(map(m[0].count, "0123456789")) <= PHONE_DIGITS[1]:
                found.append(("phone", *m.span()))
    return found


def other_identifiers(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs that look like identifiers and touch none of ``spans``."""
    held = sorted((a, b) for _, a, b in spans)
    ends, most = [], 0
    for _, b in held:
        most = max(most, b)
        ends.append(most)
    found = []
    for m in _IDENTIFIER.finditer(text):
        start, end = m.span()
        start += end - start - len(m[0].lstrip("._+/-"))
        end -= len(m[0]) - len(m[0].rstrip("._+/-(@"))
        if not 0 < end - start <= LONGEST:
            continue
        value = text[start:end]
        if "@" not in value and sum(map(value.count, "0123456789")) < LEAST_DIGITS:
            continue
        before = bisect_right(held, (end - 1, len(text) + 1))  # spans that begin before the end
        if not before or ends[before - 1] <= start:
            found.append((start, end))
    return found


def one_word(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ _ONE_WORD)


def two_words(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix((first * _STEP + second) ^ _TWO_WORDS)


def _hashes(words: list[str]) -> np.ndarray:
    return word_hashes([w.lower().encode("utf-8", "surrogatepass") for w in words])


def value_hash(value: str) -> int:
    """Of the letters and digits alone, so that spacing and signs make no new instance."""
    plain = "".join(c for c in value.lower() if c.isalnum())
    return int(np.array(xxhash.xxh3_64_intdigest(plain.encode()), "u8").view("i8"))


def places(text: str) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """Base spans, and the identifiers: (start, end, kind or None, value, left words, pattern hashes)."""
    spans = base_spans(text)
    marks = [(a, b, kind) for kind, a, b in spans] + [(a, b, None) for a, b in other_identifiers(text, spans)]
    if not marks:
        return spans, []
    words = [m.span() for m in _WORD.finditer(text)]
    ends = [b for _, b in words]
    found = []
    for a, b, kind in marks:
        n = bisect_right(ends, a)
        left = [text[x:y].lower() for x, y in words[max(n - 2, 0) : n]]
        hashes = _hashes(left)
        one = int(one_word(hashes[-1:]).view("i8")[0]) if left else None
        two = int(two_words(hashes[:1], hashes[1:]).view("i8")[0]) if len(left) == 2 else None
        found.append((a, b, kind, value_hash(text[a:b]), " ".join(left), one, two))
    return spans, found


_SPANS = "array<struct<kind:string,start:int,`end`:int>>"
_PLACES = "array<struct<start:int,`end`:int,kind:string,value:bigint,words:string,one:bigint,two:bigint>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, spans, places) of each row's text; rows are numbered."""

    def make():
        def work(batch: pa.RecordBatch):
            spans, held = [], []
            for text in batch.column(1).to_pylist():
                base, found = places(text or "")
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                held.append(
                    [dict(zip(("start", "end", "kind", "value", "words", "one", "two"), x)) for x in found]
                )
            return {"doc_id": batch.column(0), "spans": spans, "places": held}

        return work

    kind = docs.select(id_col).dtypes[0][1]
    rows = map_batches(docs.select(id_col, text_col), make, f"doc_id {kind}, spans {_SPANS}, places {_PLACES}")
    return rows.withColumn("row", F.monotonically_increasing_id())


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits at the top ``FILTER_BITS`` of each hash: at most 2 ** FILTER_BITS / 64 rows reach the driver."""
    place = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    found = np.zeros(1 << (FILTER_BITS - 6), "u8")
    found[rows["at"].to_numpy("i8")] = rows["bits"].to_numpy("i8").view("u8")
    return found


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, total): how often the words of each of ``patterns`` occur in all texts."""
    bits = bit_filter(patterns, "pattern")
    shift = np.uint64(64 - FILTER_BITS)

    def make():
        def passing(hashes: np.ndarray) -> np.ndarray:
            at = hashes >> shift
            return hashes[(bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]

        def work(batch: pa.RecordBatch):
            held = []
            for text in batch.column(0).to_pylist():
                words = _WORD.findall(text or "")
                if words:
                    hashes = _hashes(words)
                    held += [passing(one_word(hashes)), passing(two_words(hashes[:-1], hashes[1:]))]
            if not held:
                return None
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            return zip(found.view("i8").tolist(), counts.tolist())

        return work

    def run(batches):
        """Counts of a task, not of a batch; given out early where they are many."""
        work, sums = make(), {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], ["pattern", "total"])

        for batch in batches:
            for pattern, count in work(batch) or ():
                sums[pattern] = sums.get(pattern, 0) + count
            if len(sums) >= HELD_COUNTS:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    bounded_batches(docs.sparkSession)
    counted = docs.select(text_col).mapInArrow(run, "pattern bigint, total bigint")
    # Added up before the join, so that it meets each pattern once and not once a batch; Spark moves a
    # semi join below the sum if ``patterns`` is small, but no inner join.
    totals = counted.groupBy("pattern").agg(F.sum("total").alias("total"))
    return totals.join(patterns.select("pattern").distinct(), "pattern")


def _by_pattern(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each pattern of each row."""
    patterns = F.explode(F.filter(F.array("one", "two"), lambda p: p.isNotNull()))
    return rows.select(patterns.alias("pattern"), *columns)


def learnt(docs: DataFrame, found: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, words, and a confidence for each kind) and values (value, worth for each kind).

    ``found``: rows of :func:`scanned`, written.
    """
    edges = written(
        found.select(F.explode("places").alias("p"))
        .select("p.*")
        .groupBy("value", "one", "two")
        .agg(
            F.count(F.lit(1)).alias("places"),
            F.min("words").alias("words"),
            *(F.max(F.coalesce(F.col("kind") == kind, F.lit(False)).cast("double")).alias(kind) for kind in BASE),
        )
    )
    seeds = written(
        edges.groupBy("value")
        .agg(*(F.max(kind).alias(kind) for kind in BASE))
        .where(F.greatest(*BASE) > 0)
    )
    edges = edges.select("value", "one", "two", "places", "words")
    # A pattern needs SUPPORT different instances however they are valued: only such patterns are counted.
    possible = written(
        _by_pattern(edges, "value", "places")
        .groupBy("pattern", "value")
        .agg(F.sum("places").alias("places"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("instances"), F.sum("places").alias("identifiers"))
        .where(F.col("instances") >= SUPPORT)
        .select("pattern", "identifiers")
    )
    totals = written(occurrences(docs, possible.select("pattern"), text_col).join(possible, "pattern"))
    others = F.col("total") - F.col("identifiers") + UNKNOWN * (F.col("identifiers") - F.col("known")) + 1
    values, trusted = seeds, None
    for step in range(rounds):
        per_value = (
            _by_pattern(edges.join(values, "value"), "value", "places", "words", *BASE)
            .groupBy("pattern", "value")
            .agg(F.sum("places").alias("places"), F.min("words").alias("words"), *(F.max(k).alias(k) for k in BASE))
        )
        trusted = written(
            per_value.groupBy("pattern")
            .agg(
                F.min("words").alias("words"),
                F.sum("places").alias("known"),
                *(F.sum(F.col("places") * F.col(k)).alias(k) for k in BASE),
                *(F.sum(F.col("places") * F.greatest(k, F.lit(UNKNOWN))).alias(f"held_{k}") for k in BASE),
                *(F.count_if(F.col(k) >= WORTH).alias(f"n_{k}") for k in BASE),
            )
            .join(totals, "pattern")
            .select(
                "pattern",
                "words",
                *(
                    F.when(F.col(f"n_{k}") >= SUPPORT, _tidy(F.col(k) / (F.col(f"held_{k}") + others))).otherwise(0.0).alias(k)
                    for k in BASE
                ),
            )
            .where(F.greatest(*BASE) >= CONFIDENCE)
        )
        placed = _with_confidence(edges, trusted)
        worth = placed.groupBy("value").agg(
            *(_tidy(F.sum(F.col("places") * F.col(k)) / F.sum("places")).alias(k) for k in BASE)
        )
        more = worth.where(F.greatest(*BASE) > 0).join(seeds, "value", "left_anti")
        values = written(seeds.unionByName(more))
    return trusted, values


def _tidy(value: Column) -> Column:
    """Without the last digits, which depend on the order of adding."""
    return F.round(value, 9)


def _with_confidence(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows`` with, for each kind, the larger confidence of their two patterns."""
    for name in ("one", "two"):
        own = trusted.select(F.col("pattern").alias(name), *(F.col(k).alias(f"{name}_{k}") for k in BASE))
        rows = rows.join(own, name, "left")
    return rows.select(
        "*", *(F.coalesce(F.greatest(f"one_{k}", f"two_{k}"), F.lit(0.0)).alias(k) for k in BASE)
    ).drop(*(f"{name}_{k}" for name in ("one", "two") for k in BASE))


def _best_kind(columns: list[str]) -> Column:
    """The kind with the largest value, the first of equal ones."""
    most = F.greatest(*columns)
    found = F.lit(LIKE[-1])
    for column, kind in reversed(list(zip(columns, LIKE))[:-1]):
        found = F.when(F.col(column) == most, kind).otherwise(found)
    return found


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): kind, start and end of each base span and each discovered identifier, in order."""
    found = written(scanned(docs, id_col, text_col))
    trusted, values = learnt(docs, found, text_col)
    loose = (
        found.select("row", F.explode("places").alias("p"))
        .select("row", "p.*")
        .where("kind IS NULL")
        .drop("kind")
    )
    worth = values.select("value", *(F.col(k).alias(f"worth_{k}") for k in BASE))
    here = list(BASE)
    known = _with_confidence(loose, trusted).join(worth, "value")
    overall = F.greatest(*(f"worth_{k}" for k in BASE))
    shown = known.where(
        (overall >= SURE) | (F.greatest(*here) >= CONFIDENCE) & (overall >= WORTH)
    ).withColumn("kind", _best_kind([f"worth_{k}" for k in BASE]))
    added = shown.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    both = found.select("row", "doc_id", "spans").join(added, "row", "left")
    every = F.concat("spans", F.coalesce("added", F.expr(f"cast(array() AS {_SPANS})")))
    return both.select("doc_id", in_order(every).alias("spans"))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]), s["end"], s.alias("span"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["span"])


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans, one row per document."""

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(number(kind) for kind in BASE),
        F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )
