"""Ranked lexical search of a stated set of items in all documents.

Method: norm buckets. A document is a vector of term impacts, an item one of
term weights, and a score their inner product. Vectors are met longest first,
in buckets of similar length. An item is done with all shorter buckets once the
product of its own and the bucket's length (Cauchy-Schwarz) cannot reach its
k-th best score. Inside a bucket, its heaviest terms are its focus coordinates,
just as many as needed: what the others could add is at most the product of the
two lengths outside the focus, and documents whose bound stays below the k-th
best are left out. Survivors are scored anew in 64-bit integers.

Items go in blocks of at most ``BLOCK_ITEMS`` with at most ``LARGE_ITEM``
different terms each, or of one larger item, so a block's vocabulary, the only
thing sent to all tasks, is bounded. Documents are read once for each block.
Thresholds start from the longest ``1 - FIRST_SHARE`` of the vectors; they only
spare work, every document is met.

Defined cases: NULL and empty texts have no terms, and documents without terms
don't count; items without terms have no rows; rows that repeat an item are
items of their own, rows that repeat a document are documents of their own; NULL
document ids come last among equal scores; texts are read whole; empty tables
give an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import bounded_batches, map_batches
from tablewright.operators.ordering import with_row_number

#: Fixed values of the score.
TOP, B_SHARE, K_TIMES = 20, 25, 12
ONE, SCALE = 1_000_000_000, 1000
#: Items of one block, and the different terms from which on an item is a block of its own.
BLOCK_ITEMS, LARGE_ITEM = 256, 400
#: Rows and postings of a bucket, and the ratio of its longest to its shortest vector.
BUCKET_ROWS, BUCKET_POSTINGS, BUCKET_RATIO = 4096, 2_000_000, 1.25
FIRST_SHARE = 0.98
#: Groups in which an item's candidates are merged before they meet in one.
MERGE_GROUPS = 64
#: Float bounds are widened by this share, far above their rounding errors.
SLACK = 1e-9

_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and other characters; only A-Z is lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split() if text else []


def numbered_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, block, item_id, terms, counts) of items with terms; keys are unique."""

    def make():
        def work(batch: pa.RecordBatch):
            found = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            return {
                "item_id": batch.column(0),
                "terms": [[t.decode("utf-8", "surrogatepass") for t in c] for c in found],
                "counts": [list(c.values()) for c in found],
            }

        return work

    kind = items.select(id_col).dtypes[0][1]
    split = map_batches(
        items.select(id_col, text_col), make, f"item_id {kind}, terms array<string>, counts array<bigint>"
    )
    split = split.where(F.size("terms") > 0).withColumn("large", F.size("terms") > LARGE_ITEM)
    ranked = with_row_number(split, [F.col("item_id"), F.col("terms")], ["large"], name="place")
    small_block = F.floor((F.col("place") - 1) / BLOCK_ITEMS)
    return written(
        ranked.select(
            F.monotonically_increasing_id().alias("key"),
            F.when(F.col("large"), -F.col("place")).otherwise(small_block).cast("long").alias("block"),
            "item_id", "terms", "counts",
        )
    )


def term_index(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): the count of all terms, and those of ``vocabulary`` by position with their counts."""

    def make():
        place = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(vocabulary)}

        def work(batch: pa.RecordBatch):
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                for word, count in Counter(words).items():
                    if word in place:
                        terms.append(place[word])
                        tfs.append(count)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            return {
                "doc_id": batch.column(0),
                "n": sizes,
                "terms": pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                "tfs": pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64())),
            }

        return work

    return map_batches(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col),
        make,
        "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>",
    )


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Bucket:
    """Vectors of similar length, by document and by term."""

    def __init__(self, ids: pa.Array, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int, documents: int, total: int):
        self.ids, self.starts, self.lengths, self.terms = ids, ends[:-1], np.diff(ends), terms
        m = np.array([100 - B_SHARE + B_SHARE * x * documents // total for x in n.tolist()], "i8")
        rows = np.repeat(np.arange(len(n)), self.lengths)
        self.impacts = ONE * tfs // (SCALE * tfs + K_TIMES * m[rows])
        self.squares = np.bincount(rows, self.impacts.astype(float) ** 2, minlength=len(n))
        self.longest = math.sqrt(self.squares.max()) if len(n) else 0.0
        by_term = np.argsort(terms, kind="stable")
        self.post_rows, self.post_impacts = rows[by_term], self.impacts[by_term]
        self.post_at = np.searchsorted(terms[by_term], np.arange(size + 1))

    def candidates(self, item: Item, focus: int, least: float) -> np.ndarray:
        """Documents whose bound from the item's first ``focus`` terms is not below ``least``."""
        ranges = [(self.post_at[t], self.post_at[t + 1], w) for t, w in zip(item.terms[:focus].tolist(), item.weights[:focus].tolist())]
        ranges = [r for r in ranges if r[1] > r[0]]
        if ranges:
            rows = np.concatenate([self.post_rows[a:b] for a, b, _ in ranges])
            impacts = np.concatenate([self.post_impacts[a:b] for a, b, _ in ranges]).astype(float)
            weights = np.repeat([float(w) for *_, w in ranges], [b - a for a, b, _ in ranges])
        else:
            rows, impacts, weights = np.empty(0, "i8"), np.empty(0), np.empty(0)
        inside = np.bincount(rows, impacts * weights, minlength=len(self.starts))
        met = np.bincount(rows, impacts * impacts, minlength=len(self.starts))
        outside = np.sqrt(np.maximum(self.squares - met, 0.0) + SLACK * self.squares)
        return np.flatnonzero((inside + item.rest[focus] * outside) * (1 + SLACK) >= least)

    def scores(self, rows: np.ndarray, item: Item, scratch: np.ndarray) -> np.ndarray:
        """Exact scores, in 64-bit integers."""
        scratch[item.terms] = item.weights
        lengths = self.lengths[rows]
        starts = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(self.starts[rows] - starts, lengths)
        found = np.add.reduceat(scratch[self.terms[at]] * self.impacts[at], starts)
        scratch[item.terms] = 0
        return found


class Item:
    """An item's terms, heaviest first, and its best documents so far."""

    def __init__(self, key: int, terms: list[int], weights: list[int], least: int):
        order = np.argsort(-np.array(weights, "i8"), kind="stable")
        self.key, self.terms, self.weights = key, np.array(terms, "i8")[order], np.array(weights, "i8")[order]
        squares = self.weights.astype(float) ** 2
        #: Length of the item's vector without its first 0, 1, 2, ... terms.
        self.rest = np.sqrt(np.append(np.cumsum(squares[::-1])[::-1], 0.0))
        self.least, self.best = least, np.empty((0, 3), "i8")

    def focus(self, longest: float) -> int | None:
        """How many terms decide: no document without one of them can reach ``least``. None: no document can."""
        reach = self.rest * longest * (1 + SLACK)
        if reach[0] < self.least:
            return None
        return int(np.argmax(reach < max(self.least, 1)))

    def add(self, ids: pa.Array, scores: np.ndarray, top: int) -> None:
        unknown = ids.is_null().to_numpy(zero_copy_only=False).astype("i8")
        rows = np.stack([scores, unknown, ids.fill_null(0).to_numpy()], axis=1)
        rows = np.concatenate([self.best, rows[rows[:, 0] > 0]])
        self.best = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][:top]
        if len(self.best) == top:
            self.least = max(self.least, int(self.best[-1, 0]))


def best_of(vectors: DataFrame, items: list[tuple], size: int, documents: int, total: int, top: int) -> DataFrame:
    """(key, doc_id, score): each task's best documents of each item.

    ``items``: (key, terms, weights, least score that counts). Vectors come
    longest first within a task.
    """
    bounded_batches(vectors.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [Item(*x) for x in items]
        scratch = np.zeros(size, "i8")

        def meet(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
            ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
            bucket = Bucket(
                rows.column("doc_id").combine_chunks(), rows.column("n").to_numpy(), ends,
                terms.flatten().to_numpy(), tfs.flatten().to_numpy(), size, documents, total,
            )
            for item in todo:
                focus = item.focus(bucket.longest)
                if focus is None:
                    continue
                found = bucket.candidates(item, focus, max(item.least, 1))
                if len(found):
                    item.add(bucket.ids.take(pa.array(found)), bucket.scores(found, item, scratch), top)

        held, count, postings, first = [], 0, 0, 0.0
        for batch in batches:
            start = 0
            sizes = batch.column("terms").value_lengths().to_pylist()
            for at, (length, n) in enumerate(zip(batch.column("length").to_pylist(), sizes)):
                if count and (length * BUCKET_RATIO < first or count >= BUCKET_ROWS or postings + n > BUCKET_POSTINGS):
                    meet([*held, batch.slice(start, at - start)])
                    held, start, count, postings = [], at, 0, 0
                if not count:
                    first = length
                count, postings = count + 1, postings + n
            held.append(batch.slice(start))
        if count:
            meet(held)
        for item in todo:
            if len(item.best):
                ids = pa.array(item.best[:, 2], mask=item.best[:, 1].astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), item.key)), ids, pa.array(item.best[:, 0])], schema=schema
                )

    return vectors.mapInArrow(run, "key bigint, doc_id bigint, score bigint")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each key, merged in groups first, with their ``rank``."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    for keys in (["key", "part"], ["key"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("rank") <= top
        )
    return some.select("key", "rank", "doc_id", "score")


def _searched(docs: DataFrame, block: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame | None:
    """Results of one block of items; None where no document has terms."""
    held = block.collect()
    vocabulary = sorted({t for r in held for t in r.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    index = written(term_index(docs, vocabulary, id_col, text_col).where("n > 0"))
    sums = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    if not sums.documents:
        return None
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    holding = {r["term"]: r["count"] for r in counted}
    weights = [weight(sums.documents, holding.get(i, 0)) for i in range(len(vocabulary))]
    items = []
    for r in held:
        terms = [place[t] for t in r.terms]
        items.append((r.key, terms, [weights[i] * c for i, c in zip(terms, r.counts)]))

    # Lengths put vectors in order; bounds use lengths made of the integers themselves.
    spread = F.lit(float(100 - B_SHARE)) + F.col("n") * F.lit(B_SHARE * sums.documents / sums.total)
    impact = lambda tf: F.lit(float(ONE)) * tf / (F.lit(float(SCALE)) * tf + F.lit(float(K_TIMES)) * spread)
    length = F.sqrt(F.aggregate("tfs", F.lit(0.0), lambda total, tf: total + impact(tf) * impact(tf)))
    vectors = index.where(F.size("terms") > 0).withColumn("length", length)
    cut = vectors.agg(F.percentile_approx("length", FIRST_SHARE)).first()[0]
    longest = vectors.where(F.col("length") >= F.lit(cut)) if cut is not None else vectors.limit(0)

    def best(some: DataFrame, least: dict[int, int]) -> DataFrame:
        known = [(*x, least.get(x[0], 0)) for x in items]
        return best_of(some.sortWithinPartitions(F.desc("length")), known, len(vocabulary), sums.documents, sums.total, top)

    first = ranked(best(longest, {}), top).where(F.col("rank") == top).select("key", "score").collect()
    found = ranked(best(vectors, {r.key: r.score for r in first}), top)
    names = block.select("key", "item_id")
    return found.join(F.broadcast(names), "key").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Each item's ``top`` documents: item_id, rank from 1, doc_id and score, highest first, ties by id."""
    numbered = numbered_items(items, item_col, item_text_col)
    blocks = [r.block for r in numbered.select("block").distinct().orderBy("block").collect()]
    results = [_searched(docs, numbered.where(F.col("block") == b), top, id_col, text_col) for b in blocks]
    results = [r for r in results if r is not None]
    if not results:
        kind = items.select(item_col).dtypes[0][1]
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found
