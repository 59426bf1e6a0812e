"""Records of CSV files whose quoted cells hold line breaks, read in many tasks.

A line break ends a record exactly if an even number of quotes precedes it in
the file. Spark reads the files as lines in byte ranges, in order. One aggregate
counts the quotes of each range; a prefix sum over the ranges of a file, one
small row each, tells every range whether it starts inside quotes. Then each
range cuts its own lines into records, and only the pieces of records that cross
a range's border, two of a range at most, are put together by a shuffle.

The rule holds if quotes only enclose cells, or are doubled inside them. Every
record is checked for that, and that no file ends inside quotes; where that
fails, :func:`records` returns None.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.durable import written

#: Ranges, one row each, that are broadcast; at Spark's range size that is some 250 TB.
MOST_RANGES = 2_000_000
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_RECORD = re.compile(rf"{_CELL}(?:,{_CELL})*+")
_WHOLE, _HEAD, _TAIL = 0, 1, 2
_PIECES = "file string, start long, kind int, first boolean, good boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ranges, in order, into records and pieces of records."""
    out = {name: [] for name in ("file", "start", "kind", "first", "good", "text")}
    at, held, inside, kind, first = None, [], False, _WHOLE, False

    def put(kind: int, text: str) -> None:
        whole = kind == _WHOLE
        text = text.removesuffix("\r") if whole else text
        row = (*at, kind, first, not whole or _RECORD.fullmatch(text) is not None, text)
        for values, value in zip(out.values(), row):
            values.append(value)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(values, type)
                for values, type in zip(
                    out.values(), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
                )
            ],
            names=list(out),
        )
        for values in out.values():
            values.clear()
        return batch

    for batch in batches:
        for line, file, start, opened in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != at:
                if held:
                    put(_HEAD if kind == _HEAD else _TAIL, "\n".join(held))
                at, held, inside, first = (file, start), [], opened, start == 0
                kind = _HEAD if opened else _WHOLE
            held.append(line)
            if line.count('"') % 2:
                inside = not inside
            if not inside:
                put(kind, "\n".join(held))
                held, kind, first = [], _WHOLE, False
        if out["text"]:
            yield flush()
    if held:
        put(_HEAD if kind == _HEAD else _TAIL, "\n".join(held))
        yield flush()


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(record) of all files at ``path`` without the first record of each file; None if quotes break the rule."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = written(lines.groupBy("file", "start").agg(F.pmod(F.sum(quotes), F.lit(2)).alias("odd")))
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.withColumn("after", F.pmod(F.sum("odd").over(upto), F.lit(2)))
    opened = sums.select("file", "start", (F.pmod(F.col("after") - F.col("odd"), F.lit(2)) == 1).alias("opened"))
    if ranges.groupBy("file").agg(F.pmod(F.sum("odd"), F.lit(2)).alias("odd")).where("odd = 1").limit(1).count():
        return None
    if ranges.count() > MOST_RANGES:
        return None
    # A broadcast join keeps lines where and in the order in which they are read.
    placed = lines.join(F.broadcast(opened), ["file", "start"]).select("value", "file", "start", "opened")
    pieces = placed.mapInArrow(_cut, _PIECES)
    if pieces.where(~F.col("good")).limit(1).count():
        return None
    parts = written(pieces.where(F.col("kind") != _WHOLE))
    # A record starts with a range's last piece and goes on with the first pieces of ranges after it.
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    runs = parts.select("file", "start", "kind", F.count_if(F.col("kind") == _TAIL).over(order).alias("run"))
    piece = F.struct("start", "kind", "text", "first")
    joined = (
        parts.join(runs, ["file", "start", "kind"])
        .groupBy("file", "run")
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
        .select(
            F.col("pieces")[0]["first"].alias("first"),
            F.regexp_replace(F.array_join(F.transform("pieces", lambda p: p["text"]), "\n"), r"\r\z", "").alias("text"),
        )
    )
    if joined.where(~F.col("text").rlike(_JOINED)).limit(1).count():
        return None
    every = pieces.where(F.col("kind") == _WHOLE).select("first", "text").unionByName(joined)
    return every.where(~F.col("first") & (F.col("text") != "")).select(F.col("text").alias("record"))


_JOINED = r'\A(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+\z'
