"""Nearest neighbours by cosine through a block matrix join.

Method: vectors are scaled to length one and rounded to 8-bit numbers with a
scale of their own; the length of what rounding lost is kept. Queries and
candidates are packed into blocks, and each pair of blocks is a tile: one
product of small integer matrices gives all its cosines, each within a proven
bound of the true one. Only pairs that may be among a query's nearest in the
tile are recomputed from the original vectors in double precision; heaps of at
most ``NEAREST`` pairs per query and tile are merged.

The result is exact: bounds only decide what is recomputed. Candidate blocks
are sent once to each block of queries, never pair by pair.

Defined cases: vectors that are NULL, zero or hold NULL or non-finite numbers
take no part, as queries or as candidates; vectors are compared with vectors of
as many components only; ids identify rows, so rows of the query's own id are
not candidates and a repeated query row is one query; a repeated candidate may
come more than once; ties go to the smaller id; rows without an id are no
queries, but candidates, last among ties; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import map_batches

NEAREST = 5
QUERY_PART = 50
#: Vectors in a block.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 2048
#: Room for rounding in the product of scales, far above that of double precision.
_SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, size, vector) of the rows that take part; single precision stays as it is on the way."""
    vector = F.col(vector_col)
    if vectors.select(vector_col).dtypes[0][1] != "array<float>":
        vector = vector.cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(vector, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), F.size(vector).alias("size"), vector.alias("vector"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit numbers, scales, lengths of the rounded vectors and of what rounding lost."""
    unit = unit_rows(x)
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype("i1")
    back = small * scale[:, None]
    return small, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((unit - back) ** 2).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; scaled first, so that squares stay finite."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _blocks(rows: DataFrame, rows_in_block: int, name: str) -> DataFrame:
    """Rows packed into blocks of about ``rows_in_block`` by a hash: one row (ids, vectors) each."""
    counts = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    numbered = rows.join(F.broadcast(counts), "size").withColumn(
        name, F.pmod(F.xxhash64("vec_id", "vector"), F.ceil(F.col("n") / rows_in_block))
    )
    return numbered.groupBy("size", name).agg(F.collect_list(F.struct("vec_id", "vector")).alias(f"{name}_rows"))


def _tile(query_ids, queries, ids, known, vectors, nearest: int):
    """(query row, candidate row, score) of each query's nearest in one tile; ids count where ``known``."""
    q, qs, qn, qe = quantised(queries)
    c, cs, cn, ce = quantised(vectors)
    exact_sums = 127 * 127 * q.shape[1] < 1 << 24  # integers that single precision holds
    kind = "f4" if exact_sums else "f8"
    product = (q.astype(kind) @ c.astype(kind).T).astype("f8") * qs[:, None] * cs[None, :]
    bound = qn[:, None] * ce[None, :] + qe[:, None] * cn[None, :] + qe[:, None] * ce[None, :] + _SLACK
    own = (query_ids[:, None] == ids[None, :]) & known[None, :]
    low = np.where(own, -np.inf, product - bound)
    high = np.where(own, -np.inf, product + bound)
    found = []
    kept = min(nearest, len(ids))
    least = np.partition(low, len(ids) - kept, axis=1)[:, len(ids) - kept]
    for i in range(len(query_ids)):
        maybe = np.flatnonzero((high[i] >= least[i]) & ~own[i])
        if not len(maybe):
            continue
        scores = cosines(np.broadcast_to(queries[i], (len(maybe), queries.shape[1])), vectors[maybe])
        best = np.lexsort((ids[maybe], ~known[maybe], -scores))[:nearest]
        found.append((np.full(len(best), i), maybe[best], scores[best]))
    return found


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_part: int = QUERY_PART,
    count: int = NEAREST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of each row whose id is divisible by ``query_part``."""
    rows = written(usable(vectors, id_col, vector_col))
    queries = rows.where(F.col("vec_id") % query_part == 0).dropDuplicates(["vec_id"])
    query_blocks = written(_blocks(queries, QUERY_BLOCK, "q"))
    candidate_blocks = _blocks(rows, CANDIDATE_BLOCK, "c")
    # A tile for each block of candidates and of queries with as many components.
    listed = query_blocks.groupBy("size").agg(F.max("q").alias("last"))
    tiles = (
        candidate_blocks.join(F.broadcast(listed), "size")
        .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .join(query_blocks, ["size", "q"])
        .select("q_rows", "c_rows")
    )

    def make():
        def unpacked(cell):
            listed = cell.values
            ids, flat = listed.field("vec_id"), listed.field("vector")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            return ids.fill_null(0).to_numpy(), known, flat.flatten().to_numpy().astype("f8").reshape(len(ids), -1)

        def work(batch: pa.RecordBatch):
            found = []
            for row in range(batch.num_rows):
                query_ids, _, q = unpacked(batch.column(0)[row])
                ids, known, c = unpacked(batch.column(1)[row])
                for i, near, score in _tile(query_ids, q, ids, known, c, count):
                    found.append((query_ids[i], ids[near], ~known[near], score))
            if not found:
                return None
            return {
                "query_id": np.concatenate([x[0] for x in found]),
                "vec_id": pa.array(np.concatenate([x[1] for x in found]), mask=np.concatenate([x[2] for x in found])),
                "score": np.concatenate([x[3] for x in found]),
            }

        return work

    best = map_batches(tiles, make, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= count)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
