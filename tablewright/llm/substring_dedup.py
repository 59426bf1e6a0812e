"""Removal of passages that repeat across or within documents.

Method: a Rabin-Karp hash of each window of ``WINDOW`` words is rolled over
every document, and Spark finds the first place of each hash. Windows that
start later than the first place of the same words are repeats; a document's
repeated windows merge into maximal intervals, which are removed.

Most windows occur once. They are told apart before their hashes are shuffled:
each window names its anchor, the run of ``ANCHOR`` words in it with the
smallest hash. Equal windows have equal anchors, and neighbouring windows
mostly share one, so only about one anchor for eight words is counted. A window
whose anchor occurs at one place of the corpus cannot repeat; all others are
compared by anchor and window hash, 128 bits in all. Nothing is dropped that
could matter. Windows travel packed, one row for each place of an anchor. Those
of frequent anchors (more than ``FREQUENT`` places) are combined on the map
side instead, so no task gathers all places of a common passage.

Documents of the same word sequence are taken together first: of each such
group, all but the first are repeats as a whole.

A document is an id with a text, so whatever is found for it is kept by
(id, hash of the text). Ids that repeat with different texts are different
documents; of these, the one with the smaller hash is the earlier.

Defined cases: NULL texts have no words; texts shorter than a window keep all
words; texts are taken whole; rows that repeat an id (or NULL) with the same
text are judged as one document; rows without id come last, with the largest
long; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import map_batches, released
from tablewright.llm.words import split_words, window_hashes, word_hashes

WINDOW = 20
ANCHOR = 5
#: Places from which an anchor's windows are counted with a combining shuffle.
FREQUENT = 1000
#: The place in the order of rows without id.
LAST_ID = 2**63 - 1
#: What a document is known by on the way.
KEY = ["doc_id", "tag"]


def anchors(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, place) of each window: the smallest run of ANCHOR words in it, the last among equals."""
    runs = window_hashes(hashes, ANCHOR)
    width = window - ANCHOR + 1
    count = len(runs) - width + 1
    if count <= 0:
        return np.empty(0, "u8"), np.empty(0, "i8")
    # Smallest of ``width`` neighbours by doubling spans.
    best, place, span = runs, np.arange(len(runs)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        later = right <= left
        place = np.where(later, place[step:], place[: len(place) - step])
        best = np.where(later, right, left)
        span += step
    return best[:count], place[:count]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, text, given): the key of each row's document, its text and its id as given."""
    given, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(
        F.coalesce(given, F.lit(LAST_ID)).alias("doc_id"),
        # Rows without id never share a key with rows of the largest id.
        F.when(given.isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.xxhash64(text)).alias("tag"),
        text.alias("text"),
        given.alias("given"),
    )


def _documents(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, content) of each row with a window; content identifies the word sequence."""

    def make():
        import xxhash

        def work(batch: pa.RecordBatch):
            contents = []
            for text in batch.column(2).to_pylist():
                words = split_words(text)
                contents.append(xxhash.xxh3_128_digest(b" ".join(words)) if len(words) >= WINDOW else None)
            return {"doc_id": batch.column(0), "tag": batch.column(1), "content": contents}

        return work

    found = map_batches(rows.select(*KEY, "text"), make, "doc_id long, tag long, content binary")
    return found.where("content is not null")


def _anchor_places(rows: DataFrame) -> DataFrame:
    """(anchor, doc_id, tag, n): each distinct anchor of a document and the number of its places."""

    def make():
        def work(batch: pa.RecordBatch):
            owners, found, places = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                values, place = anchors(word_hashes(split_words(text)))
                if len(values):
                    first = np.concatenate([[True], place[1:] != place[:-1]])
                    distinct, n = np.unique(values[first], return_counts=True)
                    owners.append(np.full(len(distinct), row))
                    found.append(distinct)
                    places.append(n)
            if not owners:
                return None
            owner = pa.array(np.concatenate(owners))
            return {
                "anchor": np.concatenate(found).view("i8"),
                "doc_id": batch.column(0).take(owner),
                "tag": batch.column(1).take(owner),
                "n": np.concatenate(places),
            }

        return work

    return map_batches(rows.select(*KEY, "text"), make, "anchor long, doc_id long, tag long, n long")


def _repeated_anchors(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, tag, anchors): anchors of each document that occur elsewhere, with whether they are frequent."""
    places = written(_anchor_places(rows))
    often = (
        places.groupBy("anchor")
        .agg(F.sum("n").alias("total"))
        .where("total > 1")
        .select("anchor", (F.col("total") > FREQUENT).alias("frequent"))
    )
    found = (
        places.join(often, "anchor")
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("anchor", "frequent")).alias("anchors"))
    )
    return written(found.join(copies, KEY, "left_anti"))


def _suspects(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(anchor, frequent, doc_id, tag, start, windows): hashes of the consecutive windows of each place of an anchor."""
    both = rows.join(repeated, KEY).select(*KEY, "text", "anchors")

    def make():
        def work(batch: pa.RecordBatch):
            owners, found, often, starts, windows = [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                hashes = word_hashes(split_words(text))
                values, place = anchors(hashes)
                rolled = window_hashes(hashes, WINDOW).view("i8")
                listed = batch.column(3)[row].values
                wanted = listed.field("anchor").to_numpy(zero_copy_only=False)
                order = np.argsort(wanted)
                wanted = wanted[order]
                frequent = listed.field("frequent").to_numpy(zero_copy_only=False)[order]
                turns = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
                keys = values[turns].view("i8")
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                ends = np.concatenate([turns[1:], [len(values)]])
                for k in np.flatnonzero(wanted[at] == keys):
                    owners.append(row)
                    found.append(keys[k])
                    often.append(bool(frequent[at[k]]))
                    starts.append(turns[k])
                    windows.append(rolled[turns[k] : ends[k]])
            if not owners:
                return None
            lengths = np.cumsum([0, *map(len, windows)]).astype("i4")
            return {
                "anchor": np.array(found, "i8"),
                "frequent": often,
                "doc_id": batch.column(0).take(pa.array(owners)),
                "tag": batch.column(1).take(pa.array(owners)),
                "start": np.array(starts, "i4"),
                "windows": pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(windows))),
            }

        return work

    schema = "anchor long, frequent boolean, doc_id long, tag long, start int, windows array<long>"
    return map_batches(both, make, schema)


def _one_by_one(suspects: DataFrame) -> DataFrame:
    return suspects.select("anchor", *KEY, "start", F.posexplode("windows").alias("nth", "window")).select(
        "anchor", "window", *KEY, (F.col("start") + F.col("nth")).alias("start")
    )


def repeated_windows(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, tag, starts): where each document's windows start that repeat an earlier one.

    Documents in ``copies`` repeat an earlier one as a whole and are left out.
    """
    repeated = _repeated_anchors(rows, copies)
    released(rows.sparkSession)
    suspects = written(_suspects(rows, repeated))
    released(rows.sparkSession)
    # The packed rows are dealt by anchor; their windows are then in place for (anchor, window).
    same = Window.partitionBy("anchor", "window").orderBy(*KEY, "start")
    rare = _one_by_one(suspects.where("not frequent").repartition("anchor"))
    none = F.array().cast("array<int>")
    later = (
        rare.withColumn("nth", F.rank().over(same))
        .where("nth > 1")
        .groupBy(*KEY)
        .agg(F.collect_list("start").alias("starts"))
        .select(*KEY, "starts", none.alias("firsts"))
    )
    # Of frequent anchors, every window repeats but the first of its words.
    frequent = suspects.where("frequent")
    all_starts = frequent.select(
        *KEY,
        F.sequence("start", F.col("start") + F.size("windows") - 1).alias("starts"),
        none.alias("firsts"),
    )
    first = (
        _one_by_one(frequent)
        .groupBy("anchor", "window")
        .agg(F.min(F.struct(*KEY, "start")).alias("first"))
        .select("first.doc_id", "first.tag", none.alias("starts"), F.array("first.start").alias("firsts"))
    )
    found = later.unionByName(all_starts).unionByName(first).groupBy(*KEY)
    repeats = found.agg(
        F.array_sort(
            F.array_except(F.flatten(F.collect_list("starts")), F.flatten(F.collect_list("firsts")))
        ).alias("starts")
    )
    return written(repeats.where(F.size("starts") > 0))


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    edges = np.zeros(n + 1, "i8")
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(edges[:n]) > 0


def intervals(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of removed words."""
    gone = np.concatenate([[False], _covered(starts, n), [False]]).astype("i1")
    turns = np.flatnonzero(np.diff(gone))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, removed, kept_text): each document without its repeated passages.

    ``removed`` lists the intervals of removed words; kept words are joined by one space.
    """
    rows = _keyed(docs, id_col, text_col)
    known = written(_documents(rows))
    same = known.groupBy("content").agg(F.min(F.struct(*KEY)).alias("first"))
    copies = (
        known.join(same, "content")
        .where("doc_id <> first.doc_id or tag <> first.tag")
        .select(*KEY)
        .distinct()
    )
    copies = written(copies)
    starts = repeated_windows(rows, copies)
    released(docs.sparkSession)
    whole = copies.select(*KEY, F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    marked = whole.unionByName(starts.select(*KEY, F.lit(False).alias("copy"), "starts"))
    both = rows.join(marked, KEY, "left").select("given", "text", "copy", "starts")

    def make():
        def work(batch: pa.RecordBatch):
            counts, removed, kept = [], [], []
            copy, found = batch.column(2).to_pylist(), batch.column(3)
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = split_words(text)
                n = len(words)
                if copy[row]:
                    gone, left = [(0, n)], []
                elif found[row].is_valid:
                    gone = intervals(found[row].values.to_numpy(zero_copy_only=False), n)
                    ends = [0, *(x for pair in gone for x in pair), n]
                    left = [w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]
                else:
                    gone, left = [], words
                counts.append(n)
                removed.append([{"from": a, "to": b} for a, b in gone])
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            return {"doc_id": batch.column(0), "n_words": counts, "removed": removed, "kept_text": kept}

        return work

    return map_batches(
        both,
        make,
        "doc_id long, n_words long, removed array<struct<`from`:int,`to`:int>>, kept_text string",
    )


def digests(found: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + (x["to"] - x["from"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        gone.alias("n_removed"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )
