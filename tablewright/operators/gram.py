"""Correlations of many columns from masked Gram matrices, in one scan.

With X the values of a block of rows, less each column's first one, missing ones
set to 0, and M the mask of those present, M'M counts the rows of each pair of
columns, X'M and (X*X)'M sum a column over the rows where the other is present,
and X'X sums the products. These give each pair's means and co-moments over its
own rows; two sets of them merge exactly as those of two samples do. Each task
keeps one set, a square matrix of each kind, and sends it out row by row; rows
are merged in groups of ``MERGED`` tasks, then over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.coerce import ref

#: Rows of a block, whatever the size of the batches that Spark hands out.
BLOCK_ROWS = 4096
MERGED = 64
_FIELDS = ("n", "mean", "mean_other", "square", "square_other", "product")
_KIND = "part long, a int, " + ", ".join(f"`{f}` array<double>" for f in _FIELDS)


def moments(x: np.ndarray) -> np.ndarray:
    """Count, both means, both sums of squared deviations and co-moment of each pair of columns of ``x``."""
    there = np.isfinite(x)
    first = np.argmax(there, axis=0)
    start = np.where(there.any(axis=0), x[first, np.arange(x.shape[1])], 0.0)
    shifted = np.where(there, x - start, 0.0)
    mask = there.astype(float)
    n = mask.T @ mask
    total = shifted.T @ mask
    squares = (shifted * shifted).T @ mask
    some = np.maximum(n, 1)
    mean = total / some
    square = np.maximum(squares - total * mean, 0.0)
    product = shifted.T @ shifted - total * mean.T
    at = np.where(n > 0, start[:, None] + mean, 0.0)
    return np.stack([n, at, at.T, square, square.T, product])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    # A side without rows has no say in the means.
    apart = np.where((a[0] > 0) & (b[0] > 0), b[1:3] - a[1:3], 0.0)
    weight = b[0] / some
    means = np.where(a[0] > 0, a[1:3], b[1:3]) + apart * weight
    spread = a[0] * weight
    x, y = apart
    return np.stack(
        [n, *means, a[3] + b[3] + x * x * spread, a[4] + b[4] + y * y * spread, a[5] + b[5] + x * y * spread]
    )


def wide_correlations(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, r) of every pair, over the rows where both are present; ``values`` are DOUBLE."""
    names = list(columns)
    size = len(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(at, BLOCK_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in block.columns])
                found = moments(x)
                held = found if held is None else merged(held, found)
        if held is not None:
            rows = [pa.array(np.zeros(size, "i8")), pa.array(np.arange(size, dtype="i4"))]
            rows += [pa.array(list(matrix), pa.list_(pa.float64())) for matrix in held]
            yield pa.RecordBatch.from_arrays(rows, names=["part", "a", *_FIELDS])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        found = None
        for row in rows[list(_FIELDS)].itertuples(index=False):
            own = np.stack([np.array(x, float) for x in row])
            found = own if found is None else merged(found, own)
        head = {"part": [0], "a": [rows["a"].iloc[0]]}
        return pd.DataFrame(head | {f: [x] for f, x in zip(_FIELDS, found)})

    rows = values.select(*[ref(c) for c in names]).mapInArrow(scan, _KIND)
    part = F.pmod(F.spark_partition_id(), F.lit(MERGED)).cast("long")
    rows = rows.withColumn("part", part).groupBy("part", "a").applyInPandas(together, _KIND)
    rows = rows.groupBy("a").applyInPandas(together, _KIND)
    listed = F.array(*[F.lit(c) for c in names])
    pair = F.arrays_zip(F.sequence(F.lit(0), F.lit(size - 1)).alias("b"), *[F.col(f) for f in _FIELDS[3:]])
    cells = rows.select("a", F.inline(pair)).toDF("a", "b", *_FIELDS[3:]).where("b > a")
    # Without rows, pairs have no r but are listed.
    ids = values.sparkSession.range(size).select(F.col("id").cast("int").alias("a"))
    pairs = ids.where(F.col("a") < size - 1).select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(size - 1))).alias("b"))
    return pairs.join(cells, ["a", "b"], "left").select(
        F.get(listed, F.col("a")).alias("column_a"),
        F.get(listed, F.col("b")).alias("column_b"),
        F.try_divide(F.col("product"), F.sqrt("square") * F.sqrt("square_other")).alias("r"),
    )
