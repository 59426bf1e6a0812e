"""Why a metric changed between the two latest periods.

One scan summarises every period; a second, range-filtered scan attributes
the change to the values of all dimensions at once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.durable import written
from tablewright.functions.coerce import (
    day_of,
    label,
    number,
    ref,
    require_columns,
    text,
    timestamp,
)
from tablewright.functions.periods import (
    check_period,
    next_start,
    period_label,
    period_start,
    timestamp_text,
)

COMPARISON_MODES = ("full", "comparable")
TOP_CONTRIBUTORS = 10

DAY_WARNING = "The current day is not over: both days are compared up to the same time."
PERIOD_WARNING = "The current period is not over: both are compared up to the same day."

_COMPARISON_SCHEMA = (
    "metric string, previous_period string, current_period string, previous_value double, "
    "current_value double, absolute_change double, percentage_change double, direction string"
)
_QUALITY_SCHEMA = (
    "comparison_mode string, current_period_complete boolean, current_period_last_day int, "
    "current_period_last_date string, warning string, previous_start string, "
    "previous_end string, current_start string, current_end string"
)


@dataclass(frozen=True)
class RootCause:
    """``comparison`` and ``quality`` have one row; the rest one row per value."""

    comparison: DataFrame
    quality: DataFrame
    contributors: DataFrame
    reconciliation: DataFrame
    top_contributors: DataFrame


def _midnight(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time())


def _literal(moment: dt.datetime, dtype: T.DataType) -> Column:
    kind = dtype.simpleString() if not isinstance(dtype, T.StringType) else "timestamp_ntz"
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind)


def _between(df: DataFrame, date_column: str, start: dt.datetime, end: dt.datetime) -> Column:
    """start <= date < end on the stored column, so the scan can skip row groups."""
    dtype = df.schema[date_column].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        column = ref(date_column)
    elif isinstance(dtype, T.DateType) and end.time() == dt.time():
        column = ref(date_column)
    else:
        column, dtype = timestamp(df, date_column), T.TimestampNTZType()
    return (column >= _literal(start, dtype)) & (column < _literal(end, dtype))


def _sign(value: Column, positive: str, negative: str, zero: str) -> Column:
    return F.when(value > 0, positive).when(value < 0, negative).otherwise(zero)


def _latest_periods(rows: DataFrame, period: str) -> list:
    """Totals and observed window of the two latest periods, newest first."""
    return (
        rows.groupBy(period_start(F.col("ts"), period).alias("key"))
        .agg(
            F.sum("metric").alias("total"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.bool_or(F.col("ts") != day_of(F.col("ts"))).alias("intraday"),
        )
        .orderBy(F.col("key").desc())
        .limit(2)
        .select(
            "*",
            period_label(F.col("key"), period).alias("label"),
            timestamp_text(F.col("first_ts")).alias("first_text"),
            timestamp_text(F.col("last_ts")).alias("last_text"),
        )
        .collect()
    )


def _is_complete(current, period: str) -> bool:
    """Whether the latest observation reaches the end of its period."""
    end = next_start(current["key"], period)
    if period == "D":
        last_second = _midnight(end) - dt.timedelta(seconds=1)
        return not current["intraday"] or current["last_ts"] >= last_second
    return current["last_ts"].date() >= end - dt.timedelta(days=1)


def _previous_end(previous, current, period: str) -> dt.datetime:
    """Exclusive end of the part of the previous period as long as the current one."""
    period_end = _midnight(next_start(previous["key"], period))
    if period == "D":
        elapsed = current["last_ts"] - _midnight(current["key"])
        cut = _midnight(previous["key"]) + elapsed + dt.timedelta(microseconds=1)
    else:
        elapsed = current["last_ts"].date() - current["key"]
        cut = _midnight(previous["key"] + elapsed + dt.timedelta(days=1))
    return min(cut, period_end)


def analyze_period_change(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    dimension_columns: Sequence[str] | None = None,
    period: str = "M",
    comparison_mode: str = "full",
) -> RootCause:
    """Latest available period against the one before it.

    ``comparable`` cuts the previous period at the elapsed time of an
    incomplete current one. Dimensions the table lacks are skipped.
    """
    for kind, name in (("Date", date_column), ("Metric", metric_column)):
        if name not in df.columns:
            raise ValueError(f"{kind} column '{name}' does not exist")
    check_period(period)
    if comparison_mode not in COMPARISON_MODES:
        raise ValueError(f"comparison_mode must be one of {', '.join(COMPARISON_MODES)}")
    spark = df.sparkSession

    rows = df.select(
        timestamp(df, date_column).alias("ts"), number(df, metric_column).alias("metric")
    ).na.drop()
    found = _latest_periods(rows, period)
    if not found:
        raise ValueError("no row has both a date and a number")
    if len(found) < 2:
        raise ValueError("a root cause needs two periods with rows")
    current, previous = found

    previous_from = _midnight(previous["key"])
    previous_to = _midnight(next_start(previous["key"], period))
    current_from = _midnight(current["key"])
    current_to = _midnight(next_start(current["key"], period))
    complete = _is_complete(current, period)
    warning = None
    previous_total = previous["total"]
    previous_window = (previous["first_text"], previous["last_text"])
    if comparison_mode == "comparable" and not complete:
        warning = DAY_WARNING if period == "D" else PERIOD_WARNING
        previous_to = _previous_end(previous, current, period)
        cut = (
            df.where(_between(df, date_column, previous_from, previous_to))
            .select(
                timestamp(df, date_column).alias("ts"), number(df, metric_column).alias("metric")
            )
            .na.drop()
            .agg(
                F.coalesce(F.sum("metric"), F.lit(0.0)).alias("total"),
                timestamp_text(F.min("ts")).alias("first_text"),
                timestamp_text(F.max("ts")).alias("last_text"),
            )
            .first()
        )
        previous_total = cut["total"]
        previous_window = (cut["first_text"], cut["last_text"])

    change = current["total"] - previous_total
    comparison = spark.createDataFrame(
        [
            (
                metric_column,
                previous["label"],
                current["label"],
                round(previous_total, 4),
                round(current["total"], 4),
                round(change, 4),
                round(change / abs(previous_total) * 100, 2) if previous_total else None,
                "increase" if change > 0 else "decrease" if change < 0 else "no_change",
            )
        ],
        _COMPARISON_SCHEMA,
    )
    quality = spark.createDataFrame(
        [
            (
                comparison_mode,
                complete,
                current["last_ts"].day,
                current["last_text"],
                warning,
                *previous_window,
                current["first_text"],
                current["last_text"],
            )
        ],
        _QUALITY_SCHEMA,
    )

    dimensions = [d for d in dimension_columns or [] if d in df.columns]
    in_previous = _between(df, date_column, previous_from, previous_to)
    in_current = _between(df, date_column, current_from, current_to)
    # One row per dimension value, kept so that the three tables share one scan.
    changes = written(
        _changes(
            df.where(in_previous | in_current), metric_column, dimensions, in_previous, in_current
        )
    )
    contributors = _contributors(changes, change)
    reconciliation = (
        changes.groupBy("position", "dimension")
        .agg(F.sum("change").alias("total"))
        .select(
            "dimension",
            F.round("total", 4).alias("dimension_change"),
            F.round(F.lit(float(change)), 4).alias("overall_change"),
            F.round(F.col("total") - F.lit(float(change)), 8).alias("error"),
        )
    )
    top = contributors.orderBy(
        F.abs("change").desc(), "position", F.col("value").asc_nulls_last()
    ).limit(TOP_CONTRIBUTORS)
    return RootCause(
        comparison,
        quality,
        contributors.orderBy(
            "position", F.abs("change").desc(), F.col("value").asc_nulls_last()
        ).drop("position"),
        reconciliation,
        top.drop("position"),
    )


def _changes(
    window: DataFrame,
    metric_column: str,
    dimensions: Sequence[str],
    in_previous: Column,
    in_current: Column,
) -> DataFrame:
    """Previous and current total per value of every dimension, in one shuffle.

    Both sides come from conditional sums, so no join is needed and a value
    absent on one side counts as 0. Sums are combined before the shuffle.
    """
    if not dimensions:
        return window.sparkSession.createDataFrame(
            [],
            "position int, dimension string, value string, previous double, current double, "
            "change double",
        )
    metric = number(window, metric_column)
    cells = window.where(metric.isNotNull()).select(
        F.when(in_previous, metric).alias("_previous"),
        F.when(in_current, metric).alias("_current"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(d).alias("dimension"),
                        text(window, d).alias("value"),
                    )
                    for i, d in enumerate(dimensions)
                ]
            )
        ),
    )
    return (
        cells.groupBy("position", "dimension", "value")
        .agg(
            F.coalesce(F.sum("_previous"), F.lit(0.0)).alias("previous"),
            F.coalesce(F.sum("_current"), F.lit(0.0)).alias("current"),
        )
        .withColumn("change", F.col("current") - F.col("previous"))
    )


def _contributors(changes: DataFrame, total_change: float) -> DataFrame:
    share = (
        F.col("change") / F.lit(float(total_change)) * 100 if total_change else F.lit(0.0)
    )
    return changes.select(
        "position",
        "dimension",
        label(F.col("value")).alias("value"),
        F.round("previous", 4).alias("previous_value"),
        F.round("current", 4).alias("current_value"),
        F.round("change", 4).alias("change"),
        F.round(share, 2).alias("contribution_pct"),
        _sign(F.col("change"), "positive", "negative", "neutral").alias("impact"),
    )


def root_cause(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    dimension_columns: Sequence[str] | None = None,
    period: str = "M",
    comparison_mode: str = "comparable",
) -> RootCause:
    """``analyze_period_change`` with the comparable window as default."""
    return analyze_period_change(
        df, date_column, metric_column, dimension_columns, period, comparison_mode
    )


def top_by_contribution(contributors: DataFrame, k: int = 8) -> DataFrame:
    """Contributors ranked by their share of the total change."""
    return contributors.orderBy(
        F.abs("contribution_pct").desc(), "dimension", F.col("value").asc_nulls_last()
    ).limit(k)
