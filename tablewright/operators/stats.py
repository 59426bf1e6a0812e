"""Descriptive statistics, correlations and IQR outliers of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.coerce import number, ref, require_columns
from tablewright.operators.gram import wide_correlations
from tablewright.operators.quantiles import (
    IN_MEMORY_ROWS,
    column_quantiles,
    quantile_table,
)

NARROW_PAIRS = 100
QUARTILES = (0.25, 0.5, 0.75)

# Advice by share of outliers.
FEW_OUTLIERS = 0.1
FEW_ADVICE = "Cap values at the IQR bounds (winsorize)"
MANY_ADVICE = (
    "Investigate — a large share of points are flagged; the distribution may be genuinely skewed"
)


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[number(df, c).alias(c) for c in columns])


def _per_column(row: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The wide one-row aggregate ``<name><i>`` as one row per column."""
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), *[F.col(f"{n}{i}").alias(n) for n in names]
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant, NULL below 3 values."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when((n >= 3) & (F.stddev_pop(value) == 0), F.lit(0.0)).when(n >= 3, corrected)


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and bias-corrected skew, in one pass."""
    values = _numbers(df, columns)
    return _per_column(
        values.agg(*[sample_skewness(ref(c)).alias(f"skew{i}") for i, c in enumerate(columns)]),
        columns,
        ["skew"],
    )


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant, NULL below 4 values."""
    n = F.count(value).cast("double")
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when((n >= 4) & (F.stddev_pop(value) == 0), F.lit(0.0)).when(n >= 4, corrected)


def describe(
    df: DataFrame, columns: Sequence[str], in_memory_rows: int = IN_MEMORY_ROWS
) -> DataFrame:
    """count, mean, std, min, q25, q50, q75, max, skew, kurtosis per column."""
    values = _numbers(df, columns)
    folds = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "skew": sample_skewness,
        "kurtosis": sample_kurtosis,
    }
    moments = _per_column(
        values.agg(
            *[
                fold(ref(c)).alias(f"{name}{i}")
                for i, c in enumerate(columns)
                for name, fold in folds.items()
            ]
        ),
        columns,
        list(folds),
    )
    quartiles = quantile_table(
        df.sparkSession,
        column_quantiles(df, columns, QUARTILES, in_memory_rows),
        ["q25", "q50", "q75"],
    )
    return moments.join(quartiles, "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurtosis"
    )


def box_summary(
    df: DataFrame, columns: Sequence[str], in_memory_rows: int = IN_MEMORY_ROWS
) -> DataFrame:
    """Five-number summary per column."""
    return quantile_table(
        df.sparkSession,
        column_quantiles(df, columns, (0.0, *QUARTILES, 1.0), in_memory_rows),
        ["min", "q1", "median", "q3", "max"],
    ).na.drop(subset=["min"])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair, over the rows where both are present.

    r is NULL when either side is constant. One scan, and no row is shuffled:
    up to ``NARROW_PAIRS`` pairs are aggregates side by side, more come from
    Gram matrices.
    """
    values = _numbers(df, columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    if len(pairs) > NARROW_PAIRS:
        return wide_correlations(values, columns)
    folds = []
    for i, (a, b) in enumerate(pairs):
        x = F.when(ref(b).isNotNull(), ref(a))
        y = F.when(ref(a).isNotNull(), ref(b))
        folds += [
            F.covar_pop(ref(a), ref(b)).alias(f"cov{i}"),
            F.stddev_pop(x).alias(f"sx{i}"),
            F.stddev_pop(y).alias(f"sy{i}"),
        ]
    cells = [
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.try_divide(F.col(f"cov{i}"), F.col(f"sx{i}") * F.col(f"sy{i}")).alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return values.agg(*folds).select(F.inline(F.array(*cells)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Square matrix, 3 decimals, one row per column; empty below two columns."""
    half = correlations(df, columns)
    mirrored = half.select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r"
    )
    own = _numbers(df, columns).agg(
        *[F.stddev_pop(ref(c)).alias(f"sd{i}") for i, c in enumerate(columns)]
    )
    diagonal = _per_column(own, columns, ["sd"]).select(
        F.col("column").alias("column_a"),
        F.col("column").alias("column_b"),
        F.when(F.col("sd") > 0, F.lit(1.0)).alias("r"),
    )
    if len(columns) < 2:
        diagonal = diagonal.limit(0)
    cells = half.unionByName(mirrored).unionByName(diagonal)
    return (
        cells.groupBy(F.col("column_a").alias("column"))
        .pivot("column_b", list(columns))
        .agg(F.max(F.round("r", 3)))
    )


def strongest_pairs(
    df: DataFrame, columns: Sequence[str], k: int = 5, above: float | None = None
) -> DataFrame:
    """Pairs by |r| with strength band and sign; ``above`` keeps |r| > above."""
    size = F.abs("r")
    pairs = correlations(df, columns).where(F.col("r").isNotNull())
    if above is not None:
        pairs = pairs.where(size > above)
    return (
        pairs.orderBy(size.desc(), "column_a", "column_b")
        .limit(k)
        .select(
            "column_a",
            "column_b",
            "r",
            F.when(size >= 0.7, "strong")
            .when(size >= 0.4, "moderate")
            .otherwise("weak")
            .alias("strength"),
            F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
        )
    )


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], in_memory_rows: int = IN_MEMORY_ROWS
) -> dict[str, tuple[float, float]]:
    """Tukey fences per column; columns without numbers are left out."""
    quartiles = column_quantiles(df, columns, (0.25, 0.75), in_memory_rows)
    return {
        c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0]))
        for c, q in quartiles.items()
        if q
    }


def iqr_outliers(
    df: DataFrame,
    columns: Sequence[str],
    samples: int = 10,
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> DataFrame:
    """Outlier count, share, fences, samples (smallest first) and advice per column."""
    bounds = iqr_bounds(df, columns, in_memory_rows)
    names = list(bounds)
    if not names:
        return df.sparkSession.createDataFrame(
            [],
            "column string, count long, pct double, lower_bound double, upper_bound double, "
            "sample_values array<double>, treatment_suggestion string",
        )
    values = _numbers(df, names)
    outside = {
        c: (ref(c) < F.lit(bounds[c][0])) | (ref(c) > F.lit(bounds[c][1])) for c in names
    }
    counts = _per_column(
        values.agg(
            *[
                expr.alias(f"{name}{i}")
                for i, c in enumerate(names)
                for name, expr in (
                    ("valid", F.count(ref(c))),
                    ("count", F.count_if(outside[c])),
                    ("lower_bound", F.lit(bounds[c][0])),
                    ("upper_bound", F.lit(bounds[c][1])),
                )
            ]
        ),
        names,
        ["valid", "count", "lower_bound", "upper_bound"],
    )
    flagged = values.select(
        F.inline(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            outside[c], F.struct(F.lit(c).alias("column"), ref(c).alias("value"))
                        )
                        for c in names
                    ]
                )
            )
        )
    )
    smallest = Window.partitionBy("column").orderBy("value")
    sampled = (
        flagged.withColumn("rank", F.row_number().over(smallest))
        .where(F.col("rank") <= samples)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    )
    share = F.try_divide(F.col("count").cast("double"), F.col("valid").cast("double"))
    return counts.join(sampled, "column", "left").select(
        "column",
        "count",
        F.round(share * 100, 2).alias("pct"),
        "lower_bound",
        "upper_bound",
        F.coalesce("sample_values", F.array().cast("array<double>")).alias("sample_values"),
        F.when(share < FEW_OUTLIERS, FEW_ADVICE)
        .otherwise(MANY_ADVICE)
        .alias("treatment_suggestion"),
    )


def outlier_total(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Outliers over all columns."""
    return iqr_outliers(df, columns).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_outliers")
    )


def flagged_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at least one outlier."""
    return iqr_outliers(df, columns).where("count > 0").select("column", "count", "pct")
