"""Aggregates, group-bys, trends and rankings over one metric column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.functions.coerce import (
    label,
    number,
    ref,
    require_columns,
    require_rows,
    text,
    timestamp,
)
from tablewright.functions.periods import (
    calendar,
    check_period,
    period_label,
    period_start,
)
from tablewright.operators.quantiles import (
    IN_MEMORY_GROUP_ROWS,
    IN_MEMORY_ROWS,
    column_quantiles,
    group_quantiles,
)

AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count")


def check_aggregation(name: str) -> str:
    name = name.lower()
    if name not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}, not '{name}'")
    return name


def _fold(aggregation: str, value: Column) -> Column:
    fold = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    return fold[aggregation](value).cast("double")


def aggregate(
    df: DataFrame,
    metric_column: str,
    aggregation: str = "sum",
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> DataFrame:
    """One row: metric, aggregation, value, valid_rows, excluded_rows."""
    require_columns(df, [metric_column])
    aggregation = check_aggregation(aggregation)
    metric = number(df, metric_column)
    if aggregation == "median":
        found = column_quantiles(df, [metric_column], [0.5], in_memory_rows)[metric_column]
        value = F.lit(found[0] if found else None).cast("double")
    else:
        value = _fold(aggregation, metric)
    valid = F.count(metric)
    row = df.agg(
        value.alias("value") if aggregation != "median" else F.max(value).alias("value"),
        valid.alias("valid_rows"),
        (F.count(F.lit(1)) - valid).alias("excluded_rows"),
    )
    no_values = F.raise_error(
        F.lit(f"no numbers in '{metric_column}'")
    ).cast("double")
    return row.select(
        F.lit(metric_column).alias("metric"),
        F.lit(aggregation).alias("aggregation"),
        F.when(F.col("valid_rows") > 0, F.col("value")).otherwise(no_values).alias("value"),
        "valid_rows",
        "excluded_rows",
    )


def aggregates(
    df: DataFrame,
    metric_column: str,
    aggregations: Sequence[str],
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> DataFrame:
    """As :func:`aggregate`, one row for each of ``aggregations``, all folds of one scan.

    A median is selected beside them, by the scans it needs at its size.
    """
    require_columns(df, [metric_column])
    names = [check_aggregation(a) for a in aggregations]
    metric = number(df, metric_column)
    median = None
    if "median" in names:
        found = column_quantiles(df, [metric_column], [0.5], in_memory_rows)[metric_column]
        median = found[0] if found else None
    folds = [
        F.max(F.lit(median).cast("double")) if a == "median" else _fold(a, metric) for a in names
    ]
    row = df.agg(
        *[fold.alias(f"v{i}") for i, fold in enumerate(folds)],
        F.count(metric).alias("valid_rows"),
        (F.count(F.lit(1)) - F.count(metric)).alias("excluded_rows"),
    )
    no_values = F.raise_error(F.lit(f"no numbers in '{metric_column}'")).cast("double")
    cells = [
        F.struct(
            F.lit(a).alias("aggregation"),
            F.when(F.col("valid_rows") > 0, F.col(f"v{i}")).otherwise(no_values).alias("value"),
        )
        for i, a in enumerate(names)
    ]
    return row.select(
        F.lit(metric_column).alias("metric"), F.inline(F.array(*cells)), "valid_rows", "excluded_rows"
    )


def _by_key(rows: DataFrame, aggregation: str, in_memory_rows: int) -> DataFrame:
    """``key`` and aggregated ``value`` of (key, metric) rows."""
    if aggregation == "median":
        return group_quantiles(rows, ["key"], "metric", [0.5], in_memory_rows).select(
            "key", F.col("q0").alias("value")
        )
    return rows.groupBy("key").agg(_fold(aggregation, F.col("metric")).alias("value"))


def group_by(
    df: DataFrame,
    metric_column: str,
    dimension_column: str,
    aggregation: str = "sum",
    limit: int = 20,
    in_memory_rows: int = IN_MEMORY_GROUP_ROWS,
) -> DataFrame:
    """Groups by size of the aggregated value; NULL is a group of its own."""
    require_columns(df, [metric_column, dimension_column])
    aggregation = check_aggregation(aggregation)
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    rows = df.select(
        text(df, dimension_column).alias("key"), number(df, metric_column).alias("metric")
    ).na.drop(subset=["metric"])
    require_rows(rows, f"no numbers in '{metric_column}'")
    return (
        _by_key(rows, aggregation, in_memory_rows)
        .orderBy(F.abs("value").desc(), F.col("key").asc_nulls_last())
        .limit(limit)
        .select(label(F.col("key")).alias("dimension_value"), "value")
    )


def _dated(df: DataFrame, date_column: str, metric_column: str, period: str) -> DataFrame:
    require_columns(df, [date_column, metric_column])
    return (
        df.select(
            timestamp(df, date_column).alias("ts"), number(df, metric_column).alias("metric")
        )
        .na.drop()
        .select(period_start(F.col("ts"), period).alias("key"), "metric")
    )


def trend(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    period: str = "M",
    aggregation: str = "sum",
    in_memory_rows: int = IN_MEMORY_GROUP_ROWS,
) -> DataFrame:
    """Metric per calendar period, ascending; empty periods do not appear."""
    check_period(period)
    aggregation = check_aggregation(aggregation)
    rows = _dated(df, date_column, metric_column, period)
    require_rows(rows, "no row has both a date and a number")
    return (
        _by_key(rows, aggregation, in_memory_rows)
        .orderBy("key")
        .select(period_label(F.col("key"), period).alias("period"), "value")
    )


def filled_trend(
    df: DataFrame, date_column: str, metric_column: str, period: str = "M"
) -> DataFrame:
    """Totals for every period between the first and the last, empty ones as 0.

    The table is read once; the totals, one row per period, are stored.
    """
    totals = written(
        _dated(df, date_column, metric_column, check_period(period))
        .groupBy("key")
        .agg(F.sum("metric").alias("total"))
    )
    keys = totals.agg(F.min("key").alias("a"), F.max("key").alias("b")).select(
        F.explode(calendar(F.col("a"), F.col("b"), period)).alias("key")
    )
    return (
        keys.join(totals, "key", "left")
        .orderBy("key")
        .select(
            period_label(F.col("key"), period).alias("period"),
            F.coalesce("total", F.lit(0.0)).alias("value"),
        )
    )


def trend_direction(
    df: DataFrame, date_column: str, metric_column: str, period: str = "M"
) -> DataFrame:
    """First and last period total and whether the metric increased."""
    totals = (
        _dated(df, date_column, metric_column, check_period(period))
        .groupBy("key")
        .agg(F.sum("metric").alias("total"))
    )
    ends = totals.agg(
        F.min_by("total", "key").alias("first_value"),
        F.max_by("total", "key").alias("last_value"),
    )
    return ends.select(
        "first_value",
        "last_value",
        F.when(F.col("last_value") >= F.col("first_value"), "increased")
        .otherwise("decreased")
        .alias("direction"),
    )


def ranked_groups(
    df: DataFrame, metric_column: str, dimension_column: str, k: int = 5, bottom: bool = False
) -> DataFrame:
    """Top or bottom groups by total; rows without a group are left out."""
    require_columns(df, [metric_column, dimension_column])
    totals = (
        df.select(
            text(df, dimension_column).alias("dimension_value"),
            number(df, metric_column).alias("metric"),
        )
        .na.drop(subset=["dimension_value"])
        .groupBy("dimension_value")
        .agg(F.coalesce(F.sum("metric"), F.lit(0.0)).alias("value"))
    )
    first = F.col("value").asc() if bottom else F.col("value").desc()
    return totals.orderBy(first, "dimension_value").limit(k)


def ranked_values(
    df: DataFrame, metric_column: str, k: int = 5, bottom: bool = False
) -> DataFrame:
    """Largest or smallest values of a column."""
    require_columns(df, [metric_column])
    values = df.select(number(df, metric_column).alias("value")).na.drop()
    return values.orderBy(F.col("value").asc() if bottom else F.col("value").desc()).limit(k)


def segment_values(df: DataFrame, dimension_column: str) -> DataFrame:
    """Distinct non-blank values of a dimension, ascending, over the whole table."""
    require_columns(df, [dimension_column])
    values = df.select(text(df, dimension_column).alias("segment_value"))
    return (
        values.where(F.trim("segment_value") != "").distinct().orderBy("segment_value")
    )


def preview(df: DataFrame, limit: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """First rows as text, missing values as empty text."""
    require_columns(df, order_by or [])
    head = df.orderBy(*[ref(c) for c in order_by]) if order_by else df
    return head.limit(limit).select(
        *[F.coalesce(text(df, c), F.lit("")).alias(c) for c in df.columns]
    )
