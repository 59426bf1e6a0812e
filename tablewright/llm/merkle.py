"""A Merkle manifest of a document table, with a proof for every row.

Method: bitmap-rank indexing. Ids of one language are merged into a compressed
bitmap, a 64-bit word for each stretch of 64 ids that has any, and a popcount
directory over the words (sums of 1,024 words, of 1,024 such sums, and so on)
gives the rows before each word. A leaf's place is that sum plus the bits below
its own, so nothing is sorted. Nodes are then reduced level by level: the up to
eight digests of a run meet by the key (language, place div 8) in an array of
slots. Paths run the other way, from the root to the leaves, through the same
arrays. Everything is DataFrame code; no text is moved, and no group is larger
than 1,024 rows, however the rows spread over languages.

Defined cases: NULL fields count as ``-``; a NULL language is a language of its
own, before the others; NULL ids come first in their language; rows that repeat
an id are ordered by digest, equal rows have neighbouring places; empty and very
long texts need no rule; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import fold
from tablewright.operators.ordering import with_row_number

#: Fixed values of the manifest.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN_BITS = 3
TAMPERED_FOLDS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries that one entry of the next directory level sums up, as a power of two.
DIRECTORY_BITS = 10
WORD_BITS = 6


def field(value: Column) -> Column:
    """A leaf's field: ``-``, or the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_key, leaf, changed): the digest of each row, and of the tampered row where there is one.

    ``lang_key`` is empty for NULL and ``=lang`` otherwise: strings that order as languages do.
    """

    def digest(text: Column) -> Column:
        return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)

    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    tampered = F.coalesce(fold(F.col("doc_id"), TAMPERED_FOLDS) == 0, F.lit(False))
    return docs.select(
        "doc_id",
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("lang_key"),
        digest(F.col("text")).alias("leaf"),
        F.when(tampered, digest(lowered)).alias("changed"),
    )


def _with_counts_before(words: DataFrame, key_bits: int) -> DataFrame:
    """``words`` (g, word, n, ...) plus ``base``, the rows of g before the word, and ``total``, all rows of g."""
    sums, level = [], words.select("g", "word", "n")
    for _ in range(max(1, -(-key_bits // DIRECTORY_BITS))):
        level = written(
            level.groupBy("g", F.shiftright("word", DIRECTORY_BITS).alias("word")).agg(F.sum("n").alias("n"))
        )
        sums.append(level)
    above = sums.pop().select("g", F.col("word").alias("up"), F.lit(0).cast("long").alias("start"), F.col("n").alias("total"))
    before = Window.partitionBy("g", "up").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    for entries in [*reversed(sums), words]:
        placed = (
            entries.withColumn("up", F.shiftright("word", DIRECTORY_BITS))
            .withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .join(above, ["g", "up"])
            .withColumn("base", F.col("start") + F.col("earlier"))
        )
        above = placed.select("g", F.col("word").alias("up"), F.col("base").alias("start"), "total")
    return placed.drop("up", "earlier", "start")


def placed_leaves(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`leaves`, written, as level-0 nodes: g, i (place), n (nodes of g), digest, doc_id, changed."""
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    first = (ends.a or 0) >> WORD_BITS
    width = ((ends.b or 0) >> WORD_BITS) - first + 1
    word = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), WORD_BITS) - F.lit(first) + 1, F.lit(0).cast("long"))
    bit = F.col("doc_id").cast("long").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    keyed = rows.select(F.col("lang_key").alias("g"), word.alias("word"), bit.alias("bit"), "doc_id", "leaf", "changed")
    words = written(
        keyed.groupBy("g", "word").agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    single = F.coalesce(F.col("n") == F.bit_count("bits"), F.lit(False))
    repeats = written(words.where(~single).select("g", "word"))
    directory = _with_counts_before(words, width.bit_length())
    below = F.bit_count(
        F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit"))))
    )
    found = keyed.join(directory, ["g", "word"])
    columns = ("g", "i", F.col("total").alias("n"), F.col("leaf").alias("digest"), "doc_id", "changed")
    nodes = found.where(single).withColumn("i", F.col("base") + below).select(*columns)
    if repeats.isEmpty():
        return nodes
    # Words with repeated or NULL ids: places within the word come from the order of (id, digest).
    several = with_row_number(
        keyed.join(repeats, ["g", "word"], "left_semi"),
        [F.col("word"), F.col("doc_id").asc_nulls_first(), F.col("leaf")],
        ["g"],
        name="place",
    )
    starts = several.groupBy("g", "word").agg(F.min("place").alias("first"))
    ordered = (
        several.join(starts, ["g", "word"])
        .join(directory, ["g", "word"])
        .withColumn("i", F.col("base") + F.col("place") - F.col("first"))
    )
    return nodes.unionByName(ordered.select(*columns))


def reduced(nodes: DataFrame, kept: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (g, i, n, digest, and ``kept`` columns), and each g's root (g, level, digest).

    A level's rows are runs: g, i, n, the digest of the run, and ``slots``, its
    up to eight nodes in order.
    """
    height, most = 0, nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most, height = -(-most >> RUN_BITS), height + 1
    levels, below = [], nodes
    for _ in range(height):
        slot = F.struct(F.col("i").alias("slot"), "digest", *kept)
        runs = (
            below.where("n > 1")
            .groupBy("g", F.shiftright("i", RUN_BITS).alias("i"), F.shiftright(F.col("n") + (1 << RUN_BITS) - 1, RUN_BITS).alias("n"))
            .agg(F.array_sort(F.collect_list(slot)).alias("slots"))
        )
        joined = F.array_join(F.transform("slots", lambda s: s["digest"]), "")
        below = written(runs.withColumn("digest", F.sha2(joined, 256)))
        levels.append(below)
        kept = ()
    roots = [x.where("n = 1").select("g", F.lit(k).alias("level"), "digest") for k, x in enumerate([nodes, *levels])]
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, written(found)


def _steps(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes below ``levels`` with their ``path``: from ``tops`` (g, level, path, subroot) down, level by level.

    A path has, from the node's own run up to the root, the digests left and
    right of the way. Rows: g, slot (struct of the lowest level), path, subroot.
    """
    at, found = None, None
    for k in range(len(levels), 0, -1):
        here = tops.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "path", "subroot")
        at = here if at is None else at.unionByName(here)
        found = (
            levels[k - 1]
            .join(at, ["g", "i"])
            .select("g", "slots", "path", "subroot", F.posexplode("slots").alias("p", "slot"))
            .withColumn(
                "path",
                F.concat(
                    F.array(
                        F.struct(
                            _digests(F.slice("slots", F.lit(1), F.col("p"))).alias("left"),
                            _digests(F.slice("slots", F.col("p") + 2, F.lit(1 << RUN_BITS))).alias("right"),
                        )
                    ),
                    "path",
                ),
            )
            .select("g", "slot", "path", "subroot")
        )
        at = found.select("g", F.col("slot.slot").alias("i"), "path", "subroot")
    return found


def _digests(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: s["digest"]), "")


_NO_PATH = "cast(array() AS array<struct<`left`: string, `right`: string>>)"


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    rows = written(leaves(docs))
    payload = ("doc_id", "changed")
    nodes = written(placed_leaves(rows))
    levels, subroots = reduced(nodes, payload)
    ranked = with_row_number(subroots, [F.col("g")], name="place")
    tops = ranked.select(
        F.lit("").alias("g"), (F.col("place") - 1).alias("i"), F.col("place_total").alias("n"), "digest",
        F.col("g").alias("lang_key"), "level",
    )
    tops = written(tops)
    lang_levels, roots = reduced(tops, ("lang_key", "level"))
    root = (roots.first() or {"digest": None})["digest"]
    top = roots.select("g", "level", F.expr(_NO_PATH).alias("path"), F.col("digest").alias("subroot"))
    columns = (F.col("slot.lang_key").alias("g"), F.col("slot.level").alias("level"), "path", F.col("slot.digest").alias("subroot"))
    if lang_levels:
        ways = written(_steps(lang_levels, top).select(*columns))
    else:
        ways = tops.select(
            F.col("lang_key").alias("g"), "level", F.expr(_NO_PATH).alias("path"), F.col("digest").alias("subroot")
        )
    alone = (
        nodes.where("n = 1")
        .join(ways.where("level = 0"), "g")
        .select("doc_id", F.col("digest").alias("leaf"), "changed", "path", "subroot")
    )
    if levels:
        under = _steps(levels, ways).select(
            "slot.doc_id", F.col("slot.digest").alias("leaf"), "slot.changed", "path", "subroot"
        )
        alone = under.unionByName(alone)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate(
        "path",
        F.coalesce("changed", "leaf"),
        lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256),
    )
    return alone.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
