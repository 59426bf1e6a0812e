"""Exact duplicates, with frequent texts taken out before the shuffle.

Method: heavy-hitter split. A bounded Misra-Gries summary (Spark's
``approx_top_k``, a frequent-items sketch of that family) names the digests
that may be frequent. Their exact counts and winning rows, at most
``TRACKED`` of them, are broadcast and decide the frequent rows on the map
side. All other digests are rare by the summary's guarantee and are grouped by
an ordinary shuffle of (digest, id, length), never of texts.

Everything is DataFrame code inside the JVM.

Defined cases: NULL text counts as empty; NULL ids are allowed and lose ties;
rows that repeat an id and a text are copies of each other and both carry the
id that stays, of which ``keep_one_of_each`` keeps one; an empty table gives an empty result; further columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import unused

#: Digests the summary tracks: texts with more than about 1 in 500 of all rows are surely among them.
TRACKED = 4096
#: Groups that each have a summary; what is frequent in all rows is as frequent in one of them at least.
MERGE_GROUPS = 32
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def _digest(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.sha2(F.regexp_replace(text, WHITE_SPACE, "").cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical without white space of
    ``[\\x20\\x09-\\x0D]``. The longest original (in code points) stays, then
    the smallest id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(text).alias("size"),
            _digest(text_col).alias("text_sha256"),
        ).withColumn("print", F.xxhash64("text_sha256"))
    )
    best = F.min(F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("n"), "doc_id"))
    frequent = (
        rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g"))
        .agg(F.expr(f"approx_top_k(print, {TRACKED}, {TRACKED})").alias("top"))
        .select(F.explode("top").alias("top"))
        .groupBy("top.item")
        .agg(F.sum("top.count").alias("count"))
        .where("count > 1")
        .orderBy(F.desc("count"), "item")
        .limit(TRACKED)
    )
    # The summary only proposes: counts and winners of what it names are exact.
    heavy = written(
        rows.join(F.broadcast(frequent), rows["print"] == frequent["item"], "left_semi")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    ).hint("broadcast")
    common = rows.join(heavy, "text_sha256")
    rest = rows.join(heavy.select("text_sha256"), "text_sha256", "left_anti")
    same = Window.partitionBy("text_sha256")
    rare = rest.withColumn("group_size", F.count(F.lit(1)).over(same)).withColumn("best", best.over(same))
    columns = ("doc_id", "text_sha256", "group_size", "best")
    return (
        common.select(*columns)
        .unionByName(rare.select(*columns))
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
            "text_sha256",
        )
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text: the row whose id stays, and of rows that repeat id and text the longest."""
    kept_id, kept_sha256, rows = (unused(docs, n) for n in ("kept_id", "kept_sha256", "kept_rows"))
    kept = written(
        exact_groups(docs, id_col, text_col)
        .where("kept")
        .groupBy(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha256))
        .agg(F.count(F.lit(1)).alias(rows))
    )

    def those(which: Column) -> DataFrame:
        same = docs[id_col].eqNullSafe(F.col(kept_id)) & (_digest(text_col) == F.col(kept_sha256))
        return docs.join(kept.where(which), same, "left_semi")

    single = those(F.col(rows) == 1)
    if kept.where(F.col(rows) > 1).isEmpty():
        return single
    whole = F.struct(*(docs[c] for c in docs.columns))
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = (
        those(F.col(rows) > 1)
        .groupBy(F.col(id_col).alias("__id"), _digest(text_col).alias("__sha256"))
        .agg(F.min_by(whole, F.struct(-F.length(text), text)).alias("__row"))
    )
    return single.unionByName(one.select("__row.*"))
