"""Exact quantiles (linear interpolation) at any size, by radix selection.

A DOUBLE becomes a 64-bit whole number that orders as it does. For each wanted
rank of a group, a histogram of the first 12 bits, combined on the map side,
tells the bin that holds the rank; the next 12 bits are counted inside that bin,
and so on, six passes at most. As soon as a bin has no more than
``in_memory_rows`` rows, its distinct values are put in order by one last pass.
Groups that small from the start go to ``percentile``, which keeps the distinct
values of a group in one task. No sketch takes part and no rank can be missed:
every step counts exactly. Whole columns narrow intervals of values in place of
bits, which needs nothing but arithmetic on each row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.durable import written
from tablewright.functions.coerce import number, ref, require_columns
from tablewright.functions.joins import join_null_safe

# Rows, of one column or of one group, whose distinct values one task puts in order.
IN_MEMORY_ROWS = 100_000
IN_MEMORY_GROUP_ROWS = 250_000
# Tables of groups, or of their bins, up to this size are broadcast; the hot ones of larger tables are.
BROADCAST_GROUPS = 50_000
HOT_GROUPS = 10_000
COLUMNS_PER_PASS = 16
#: Bits that are left below each pass's histogram.
SHIFTS = (52, 40, 28, 16, 4, 0)
#: Whole columns: parts of an interval in each pass, and what makes sixteenths of an octave positive.
PARTS, OCTAVE_ZERO = 4096, 20_000


def ordered_bits(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` plus ``name``: a whole number for each DOUBLE that orders as the values do.

    The bits of the absolute value, negative below zero; both zeros and NULL are 0.
    """
    size = F.coalesce(F.abs(ref(value)), F.lit(0.0))
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), size)
    plain = rows.withColumn("_plain", bits.cast("long"))
    return plain.withColumn(name, F.when(ref(value) < 0, -F.col("_plain")).otherwise(F.col("_plain"))).drop("_plain")


def _rank(n: Column, p: float) -> Column:
    """0-based fractional rank of quantile ``p`` among ``n`` sorted values."""
    return (n - F.lit(1)) * F.lit(float(p))


def _beside_group(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], total: int, limit: int, count: int
) -> DataFrame:
    """Every row with its group's row of ``groups`` (at most ``count``, with the size as ``_n``).

    A group table of checked size is broadcast, so rows stay where they are.
    Beyond it only the hot groups are, of which there are at most
    ``HOT_GROUPS``, and the rows left to shuffle have no hot key.
    """
    if count <= limit:
        return join_null_safe(rows, F.broadcast(groups), keys)
    is_hot = F.col("_n") > F.lit(total / HOT_GROUPS)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    hot_keys = F.broadcast(hot.select(*[ref(k) for k in keys]))
    others = join_null_safe(rows, hot_keys, keys, "left_anti")
    return join_null_safe(rows, F.broadcast(hot), keys).unionByName(
        join_null_safe(others, cold, keys)
    )


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    in_memory_rows: int = IN_MEMORY_GROUP_ROWS,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Per group: keys, ``rows`` and ``q0..qk`` over non-NULL ``value`` (DOUBLE)."""
    require_columns(df, [*keys, value])
    by = [ref(k) for k in keys]
    rows = df.select(*by, number(df, value).alias("_value")).na.drop(subset=["_value"])
    sizes = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    large = sizes.where(F.col("_n") > in_memory_rows)
    total, most, hot = sizes.agg(
        F.sum("_n"), F.max("_n"), F.count_if(F.col("_n") > in_memory_rows)
    ).first()

    def small(some: DataFrame) -> DataFrame:
        found = [F.percentile("_value", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probabilities)]
        return some.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *found)

    if (most or 0) <= in_memory_rows:
        return small(rows)
    names = large.select(*by)
    few = F.broadcast(names) if hot <= broadcast_groups else names
    found = _selected(rows, large, list(keys), probabilities, in_memory_rows, total, hot, broadcast_groups)
    return small(join_null_safe(rows, few, list(keys), "left_anti")).unionByName(found)


def _holds_rank(cells: DataFrame, targets: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``targets`` beside the cell of their group that holds their rank.

    ``cells``: keys, the ``order`` column and ``_rows``; a group has few enough
    for one window. Targets have ``_below``, the rows before the group.
    """
    by = [ref(k) for k in keys]
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.withColumn("_upto", F.sum("_rows").over(running))
    end = F.col("_below") + F.col("_upto")
    return join_null_safe(targets, upto, keys).where(
        (end - F.col("_rows") <= F.col("_rank")) & (F.col("_rank") < end)
    )


def _selected(
    rows: DataFrame,
    large: DataFrame,
    keys: list[str],
    probabilities: Sequence[float],
    in_memory_rows: int,
    total: int,
    hot: int,
    limit: int,
) -> DataFrame:
    """Quantiles of the ``hot`` ``large`` groups (keys, _n) by radix selection."""
    by = [ref(k) for k in keys]
    work = ordered_bits(rows, "_value", "_bits")
    ranks = [f(_rank(F.col("_n"), p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)]
    zero = F.lit(0).cast("long")
    open_ranks = large.select(
        *by, F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"), zero.alias("_prefix"), zero.alias("_below"),
        F.col("_n").alias("_inside"),
    )
    settled, ends, count = [], 0, hot * 2 * len(probabilities)
    for done, shift in zip((None, *SHIFTS), SHIFTS):
        prefixes = open_ranks.groupBy(*by, "_prefix").agg(F.max("_inside").alias("_n"))
        prefix = zero if done is None else F.shiftright("_bits", done)
        beside = _beside_group(work.withColumn("_prefix", prefix), prefixes, [*keys, "_prefix"], total, limit, count)
        bins = beside.groupBy(*by, "_prefix", F.shiftright("_bits", shift).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_bits").alias("_low"), F.max("_bits").alias("_high")
        )
        single = F.col("_low") == F.col("_high")  # one value, however often: no more bits are needed
        found = written(
            _holds_rank(bins, open_ranks, [*keys, "_prefix"], "_bin").select(
                *by,
                "_rank",
                F.when(single, F.col("_low")).otherwise(F.col("_bin")).alias("_prefix"),
                F.when(single, 0).otherwise(shift).alias("_shift"),
                (F.col("_below") + F.col("_upto") - F.col("_rows")).alias("_below"),
                F.col("_rows").alias("_inside"),
            )
        )
        is_open = (F.col("_inside") > in_memory_rows) & (F.col("_shift") > 0)
        settled.append(found.where(~is_open))
        open_ranks = found.where(is_open).drop("_shift")
        every, count = found.agg(F.count(F.lit(1)), F.count_if(is_open)).first()
        ends += every - count
        if not count:
            break
    ranked = settled[0]
    for more in settled[1:]:
        ranked = ranked.unionByName(more)
    place = [*keys, "_shift", "_prefix"]
    leaves = ranked.groupBy(*by, "_shift", "_prefix").agg(F.max("_inside").alias("_n"))
    shifts = [F.lit(s) for s in {*SHIFTS[: len(settled)], 0}]
    spread = work.withColumn("_shift", F.explode(F.array(*shifts))).withColumn(
        "_prefix", F.call_function("shiftright", F.col("_bits"), F.col("_shift"))
    )
    values = (
        _beside_group(spread, leaves, place, total, limit, ends)
        .groupBy(*by, "_shift", "_prefix", "_value")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    picked = _holds_rank(values, ranked, place, "_value").select(*by, "_rank", "_value")
    beside = join_null_safe(picked, large, keys)
    quantiles = []
    for i, p in enumerate(probabilities):
        rank = _rank(F.col("_n"), p)
        low = F.max(F.when(F.col("_rank") == F.floor(rank), F.col("_value")))
        high = F.max(F.when(F.col("_rank") == F.ceil(rank), F.col("_value")))
        share = F.max(rank - F.floor(rank))
        # Equal ends need no arithmetic, which infinities would not survive.
        quantiles.append(F.when(low == high, low).otherwise(low + share * (high - low)).alias(f"q{i}"))
    return beside.groupBy(*by).agg(F.max("_n").alias("rows"), *quantiles)


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> dict[str, list[float] | None]:
    """Exact quantiles of whole columns; None for a column without numbers.

    Only these scalars reach the driver. A table of at most ``in_memory_rows``
    rows takes one aggregate; of larger ones, columns are groups.
    """
    require_columns(df, columns)
    if len(columns) > COLUMNS_PER_PASS:
        out: dict[str, list[float] | None] = {}
        for at in range(0, len(columns), COLUMNS_PER_PASS):
            chunk = columns[at : at + COLUMNS_PER_PASS]
            out.update(column_quantiles(df, chunk, probabilities, in_memory_rows))
        return out
    values = df.select(*[number(df, c).alias(c) for c in columns])
    if df.count() <= in_memory_rows:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        row = values.agg(
            *[F.percentile(ref(c), probs).alias(f"c{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: row[f"c{i}"] for i, c in enumerate(columns)}
    return dict(zip(columns, _select_columns(values, columns, probabilities, in_memory_rows)))


def _select_columns(
    values: DataFrame, columns: Sequence[str], probabilities: Sequence[float], in_memory_rows: int
) -> list[list[float] | None]:
    """Selection of whole columns by ever narrower intervals; the driver keeps the few of them, one job a pass.

    The first pass bins by a sixteenth of an octave. Each later one cuts the
    interval between the least and the largest value of a bin in 4,096 parts, so
    five of them reach single values. Bins are plain arithmetic that never
    decreases as the value grows, so every rank is found exactly.
    """

    def octave(i: int, low: float | None, high: float | None) -> Column:
        value = ref(columns[i])
        octaves = F.least(F.log2(F.abs(value)) * 16, F.lit(OCTAVE_ZERO - 1.0))  # infinity is above all others
        size = (F.floor(octaves) + F.lit(OCTAVE_ZERO)).cast("long")
        return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))

    def part(i: int, low: float, high: float) -> Column:
        # An infinite end is alone in its bin, so the width is finite and above zero.
        share = (ref(columns[i]) - F.lit(low)) / F.lit(high - low)
        return F.floor(share * PARTS).cast("long")

    def counted(groups: list[tuple[int, float | None, float | None]], cell) -> DataFrame:
        """Rows of each group (column, least, largest value) by ``cell`` of its column."""
        cells, any_inside = [], F.lit(False)
        for at, (i, low, high) in enumerate(groups):
            value = ref(columns[i])
            inside = value.isNotNull() if low is None else value.between(F.lit(low), F.lit(high))
            any_inside = any_inside | F.coalesce(inside, F.lit(False))
            held = F.when(inside, cell(i, low, high)).alias("_cell")
            cells.append(F.struct(F.when(inside, at).alias("_id"), held, value.alias("_all")))
        listed = values.where(any_inside).select(F.inline(F.array(*cells))).where("_id IS NOT NULL")
        return listed.groupBy("_id", "_cell")

    # Where each wanted rank is: (column, rank) -> (least and largest value, rows before them, rows among them).
    at: dict[tuple[int, int], tuple[float | None, float | None, int, int]] = {}
    groups, sizes, cell = [(i, None, None) for i in range(len(columns))], {}, octave
    while groups:
        found: dict[int, list[tuple[int, int, float, float]]] = {}
        bins = counted(groups, cell)
        for r in bins.agg(F.count(F.lit(1)).alias("n"), F.min("_all").alias("a"), F.max("_all").alias("b")).collect():
            found.setdefault(r["_id"], []).append((r["_cell"], r["n"], r["a"], r["b"]))
        if cell is octave:
            sizes = {i: sum(n for _, n, *_ in cells) for i, cells in found.items()}
            for i, n in sizes.items():
                for p in probabilities:
                    rank = (n - 1) * p
                    at |= {(i, r): (None, None, 0, n) for r in (math.floor(rank), math.ceil(rank))}
        for (i, rank), (least, largest, below, _) in at.items():
            if (i, least, largest) in groups:
                for _, n, low, high in sorted(found[groups.index((i, least, largest))]):
                    if rank < below + n:
                        at[i, rank] = (low, high, below, n)
                        break
                    below += n
        # One value, however often, needs no more parts.
        groups = sorted({(i, low, high) for (i, _), (low, high, _, n) in at.items() if n > in_memory_rows and low < high})
        cell = part
    if not at:
        return [None] * len(columns)
    leaves = sorted({(i, low, high) for (i, _), (low, high, *_) in at.items()})
    wanted = [(leaves.index((i, low, high)), i, rank, below) for (i, rank), (low, high, below, _) in at.items()]
    targets = values.sparkSession.createDataFrame(wanted, "_id int, _column int, _rank long, _below long")
    cells = counted(leaves, lambda i, *_: ref(columns[i])).agg(F.count(F.lit(1)).alias("_rows"))
    picked = _holds_rank(cells, targets, ["_id"], "_cell").collect()
    value = {(r["_column"], r["_rank"]): r["_cell"] for r in picked}

    def quantile(i: int, p: float) -> float:
        rank = (sizes[i] - 1) * p
        low, high = value[i, math.floor(rank)], value[i, math.ceil(rank)]
        return low if low == high else low + (rank - math.floor(rank)) * (high - low)

    return [[quantile(i, p) for p in probabilities] if i in sizes else None for i in range(len(columns))]


def quantile_table(
    spark, quantiles: dict[str, list[float] | None], names: Sequence[str]
) -> DataFrame:
    """The driver-side quantiles as a (column, names...) DataFrame."""
    schema = T.StructType(
        [T.StructField("column", T.StringType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )
    rows = [(c, *(q or [None] * len(names))) for c, q in quantiles.items()]
    return spark.createDataFrame(rows, schema)
