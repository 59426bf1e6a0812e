"""Row order over a whole table without sending the table to one task.

``ordered_slices`` range-partitions rows by a composite key and freezes the
partition number of every row. A prefix computation then needs one bounded
window per slice and a window over the per-slice totals, whose row count is
the number of slices (per key), not of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.functions.coerce import ref, require_columns
from tablewright.functions.joins import join_null_safe

SLICE = "_slice"
TIE = "_tie"
# Bytes of the input for one slice, and the most slices that the driver plans for.
SLICE_BYTES = 256 << 20
MOST_SLICES = 100_000
_UNKNOWN_SIZE = 1 << 60


def _slice_count(df: DataFrame) -> int:
    """Slices for the bytes of the tables that the plan reads; tables of unknown size don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    read = sum(size for size in sizes if size < _UNKNOWN_SIZE)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_SLICES, -(-read // SLICE_BYTES)))


def ordered_slices(
    df: DataFrame, order: Sequence[Column], slices: int | None = None
) -> DataFrame:
    """Rows plus ``_slice``, ascending in ``order``, and ``_tie``, a row hash.

    Unless ``slices`` is given, there are ``spark.sql.shuffle.partitions`` slices, or
    more where the tables that are read are large: about one for each ``SLICE_BYTES``.
    Equal rows fall next to each other; their last sort key is the input
    position, so a large group of copies is spread over several slices.
    """
    n = slices or _slice_count(df)
    tied = df.withColumn(TIE, F.xxhash64(*[ref(c) for c in df.columns]))
    ranged = tied.repartitionByRange(
        n, *order, F.col(TIE), F.monotonically_increasing_id()
    )
    return written(ranged.withColumn(SLICE, F.spark_partition_id()))


def with_row_number(
    df: DataFrame,
    order_by: Sequence[Column],
    partition_by: Sequence[str] = (),
    name: str = "rank",
    slices: int | None = None,
) -> DataFrame:
    """Exact 1-based row number per ``partition_by`` group, hot groups included.

    Also adds ``<name>_total``, the number of rows in the group.
    """
    require_columns(df, partition_by)
    groups = [ref(c) for c in partition_by]
    sliced = ordered_slices(df, [*groups, *order_by], slices)
    counts = sliced.groupBy(SLICE, *groups).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        SLICE,
        *groups,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*groups)).alias(f"{name}_total"),
    )
    within = Window.partitionBy(SLICE, *groups).orderBy(*order_by, F.col(TIE))
    local = sliced.withColumn("_local", F.row_number().over(within))
    joined = join_null_safe(local, offsets, [SLICE, *partition_by])
    return joined.select(
        *[ref(c) for c in df.columns],
        (F.col("_before") + F.col("_local")).alias(name),
        F.col(f"{name}_total"),
    )


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Each NULL in ``columns`` takes the last earlier value in ``order_by`` order."""
    require_columns(df, [*columns, *order_by, *partition_by])
    groups = [ref(c) for c in partition_by]
    order = [ref(c) for c in order_by]
    sliced = ordered_slices(df, [*groups, *order], slices)
    position = F.struct(*order, F.col(TIE))

    # A struct wrapper keeps "no value in this slice" apart from a value.
    tails = sliced.groupBy(SLICE, *groups).agg(
        *[
            F.max_by(ref(c), F.when(ref(c).isNotNull(), position)).alias(f"_tail{i}")
            for i, c in enumerate(columns)
        ]
    )
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = tails.select(
        SLICE,
        *groups,
        *[
            F.last(F.col(f"_tail{i}"), ignorenulls=True).over(earlier).alias(f"_carry{i}")
            for i in range(len(columns))
        ],
    )
    upto = (
        Window.partitionBy(SLICE, *groups)
        .orderBy(*order, F.col(TIE))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = sliced.select(
        "*",
        *[
            F.last(ref(c), ignorenulls=True).over(upto).alias(f"_here{i}")
            for i, c in enumerate(columns)
        ],
    )
    joined = join_null_safe(local, carried, [SLICE, *partition_by])
    filled = {c: i for i, c in enumerate(columns)}
    return joined.select(
        *[
            F.coalesce(F.col(f"_here{filled[c]}"), F.col(f"_carry{filled[c]}")).alias(c)
            if c in filled
            else ref(c)
            for c in df.columns
        ]
    )
