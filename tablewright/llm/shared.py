"""Small helpers of this subpackage: table access, bounded Arrow batches, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tablewright.durable import written

#: Rows of one Arrow batch; pairs of large sets, or long texts, then stay below some tens of megabytes.
BATCH_ROWS = 128
#: Bytes of one Arrow batch, where Spark knows the setting; one longer text still makes a batch of its own.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at once to a few megabytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, Any] | None]],
    schema: str | StructType,
) -> DataFrame:
    """``df`` through a Python function of Arrow batches.

    ``make`` runs once a task and returns the function, so that models are
    loaded once; the function returns columns by name, or None for no rows.
    """
    bounded_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (found := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [_column(found[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)


def _column(values: Any, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so when the driver's garbage is collected, which a driver with
    little to do may put off until the disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def fold(id_column: Column, parts: int) -> Column:
    """The remainder of crc32 of the id's decimal text; NULL ids have none."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts))


def components(links: DataFrame) -> DataFrame:
    """The smallest member of each member's connected component.

    ``links``: rows (a, b) of longs. Returns (member, component), one row for
    each member of a link. Labels are passed along links and halved in length
    by following them, so a chain of n members takes about log n rounds. Each
    round is written, and only counts reach the driver.
    """
    both = written(
        links.select(F.col("a").alias("x"), F.col("b").alias("y"))
        .union(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        .where("x <> y")
        .distinct()
    )
    labels = written(
        both.groupBy(F.col("x").alias("member")).agg(
            F.least(F.min("y"), F.first("x")).alias("component")
        )
    )
    while True:
        near = (
            both.join(labels, both.y == labels.member)
            .groupBy("x")
            .agg(F.min("component").alias("found"))
        )
        step = labels.join(near, labels.member == near.x).select(
            "member", F.least("component", "found").alias("component"), F.col("component").alias("was")
        )
        ahead = labels.select(F.col("member").alias("via"), F.col("component").alias("further"))
        jumped = written(
            step.join(ahead, step.component == ahead.via, "left").select(
                "member", F.least("component", F.coalesce("further", "component")).alias("component"), "was"
            )
        )
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("member", "component")
        if not changed:
            return labels
