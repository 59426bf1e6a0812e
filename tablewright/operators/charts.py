"""Chart-sized summaries of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.coerce import (
    long_form,
    number,
    ref,
    require_columns,
    text,
    timestamp,
)
from tablewright.operators.ordering import with_row_number
from tablewright.operators.profile import Profile
from tablewright.operators.stats import box_summary

CHART_COLUMNS = 8
HISTOGRAM_BINS = 20
CATEGORY_LIMIT = 12
POINT_LIMIT = 2000


def histograms(
    df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width histogram of each column, empty bins included.

    The last bin is closed on the right. A constant column gets a range of
    width 1 around its value. Infinite values have no bin and are left out.
    """
    names = list(columns)
    require_columns(df, names)
    infinity = F.lit(float("inf"))
    values = df.select(
        *[F.when(F.abs(number(df, c)) < infinity, number(df, c)).alias(f"v{i}") for i, c in enumerate(names)]
    )
    ends = values.agg(
        *[
            f(f"v{i}").alias(f"{end}{i}")
            for i in range(len(names))
            for end, f in (("lo", F.min), ("hi", F.max))
        ]
    ).first()
    ranges = {}
    for i, name in enumerate(names):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is not None:
            ranges[i] = (lo, hi) if lo < hi else (lo - 0.5, hi + 0.5)
    if not ranges:
        return df.sparkSession.createDataFrame(
            [], "column string, bin int, bin_start double, bin_end double, count long"
        )

    def bin_of(i: int):
        lo, hi = ranges[i]
        x, step = F.col(f"v{i}"), (hi - lo) / bins

        def edge(index):
            return F.when(index == bins, F.lit(hi)).otherwise(F.lit(lo) + index * F.lit(step))

        guess = F.least(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(bins - 1))
        # Rounding can put a value one bin away from its edges.
        return (
            F.when(x.isNull(), F.lit(None))
            .when(x < edge(guess), guess - 1)
            .when((guess < bins - 1) & (x >= edge(guess + 1)), guess + 1)
            .otherwise(guess)
            .cast("int")
        )

    counted = (
        values.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(names[i]).alias("column"), bin_of(i).alias("bin"))
                        for i in ranges
                    ]
                )
            )
        )
        .na.drop(subset=["bin"])
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = df.sparkSession.createDataFrame(
        [
            (
                names[i],
                b,
                lo + b * (hi - lo) / bins,
                hi if b == bins - 1 else lo + (b + 1) * (hi - lo) / bins,
            )
            for i, (lo, hi) in ranges.items()
            for b in range(bins)
        ],
        "column string, bin int, bin_start double, bin_end double",
    )
    return frame.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count")
    )


def category_counts(
    df: DataFrame, columns: Sequence[str], limit: int = CATEGORY_LIMIT
) -> DataFrame:
    """Most frequent values of each column; NULL is not counted."""
    names = list(columns)
    counts = (
        long_form(df, names)
        .na.drop(subset=["value"])
        .groupBy("column", F.col("value").alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    largest = Window.partitionBy("column").orderBy(F.col("count").desc(), "label")
    return counts.withColumn("rank", F.row_number().over(largest)).where(
        F.col("rank") <= limit
    )


def scatter_sample(
    df: DataFrame,
    x_column: str,
    y_column: str,
    key: Sequence[str] = (),
    points: int = POINT_LIMIT,
    seed: int = 42,
) -> DataFrame:
    """A repeatable random sample of at most ``points`` complete (x, y) rows.

    Rows are drawn by the hash of ``key``, the columns that identify a row.
    Without a key every column and the row's position are hashed, so copies
    are drawn independently of each other.
    """
    require_columns(df, [x_column, y_column, *key])
    identity = [text(df, c) for c in (key or df.columns)]
    if not key:
        identity.append(F.monotonically_increasing_id().cast("string"))
    draw = F.md5(F.concat_ws("|", *identity, F.lit(str(seed))))
    return (
        df.select(
            number(df, x_column).alias("x"), number(df, y_column).alias("y"), draw.alias("draw")
        )
        .na.drop(subset=["x", "y"])
        .orderBy("draw")
        .limit(points)
        .select("x", "y")
    )


def thinned_line(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    order_by: Sequence[str] = (),
    points: int = POINT_LIMIT,
) -> DataFrame:
    """Every k-th row by date, k = rows // points, keeping all rows up to ``points``."""
    require_columns(df, [date_column, metric_column, *order_by])
    rows = df.select(
        timestamp(df, date_column).alias("x"),
        number(df, metric_column).alias("y"),
        *[ref(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
    ).na.drop(subset=["x", "y"])
    ties = [F.col(f"_o{i}") for i in range(len(order_by))]
    ranked = with_row_number(rows, [F.col("x"), *ties])
    step = F.when(F.col("rank_total") > points, F.floor(F.col("rank_total") / points)).otherwise(1)
    return ranked.where(F.pmod(F.col("rank") - 1, step) == 0).select("x", "y").orderBy("x")


def chart_tables(df: DataFrame, profiled: Profile, columns: int = CHART_COLUMNS) -> dict[str, DataFrame]:
    """Every chart the columns of a table allow, by name; of the first ``columns`` of each kind."""
    numbers, categories = profiled.numerical_columns, profiled.categorical_columns
    tables = {}
    if numbers:
        tables["histograms"] = histograms(df, numbers[:columns])
        tables["box"] = box_summary(df, numbers[:columns])
    if categories:
        tables["bar"] = category_counts(df, categories[:columns])
    if len(numbers) >= 2:
        tables["scatter"] = scatter_sample(df, numbers[0], numbers[1])
    if profiled.datetime_columns and numbers:
        tables["line"] = thinned_line(df, profiled.datetime_columns[0], numbers[0])
    return tables
