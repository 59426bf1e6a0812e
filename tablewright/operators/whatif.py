"""What-if scenarios: a metric or one segment changes by a percentage."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.coerce import number, require_columns, text


def _projected(current: Column, pct: Column) -> Column:
    return F.round(current * (F.lit(1.0) + pct / F.lit(100.0)), 10)


def _check_pct(value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError("the change must be a number of percent")
    return float(value)


def run_what_if(
    df: DataFrame,
    metric_column: str,
    change_percentage: float,
    dimension_column: str | None = None,
    segment_value: Any = None,
) -> DataFrame:
    """One row: baseline, projection and impact of one scenario, from one pass."""
    if not metric_column:
        raise ValueError("a metric is needed")
    pct = F.lit(_check_pct(change_percentage))
    require_columns(df, [c for c in (metric_column, dimension_column) if c])
    metric = number(df, metric_column)
    baseline = F.coalesce(
        F.sum(metric),
        F.raise_error(F.lit(f"no numbers in '{metric_column}'")).cast("double"),
    )
    if dimension_column is None:
        if segment_value is not None:
            raise ValueError("a segment needs its dimension")
        total = df.agg(baseline.alias("baseline_total"))
        projected = _projected(F.col("baseline_total"), pct)
        return total.select(
            F.lit("metric").alias("scenario_type"),
            F.lit(metric_column).alias("metric_column"),
            "baseline_total",
            pct.alias("change_percentage"),
            projected.alias("projected_total"),
            (projected - F.col("baseline_total")).alias("absolute_impact"),
            pct.alias("percentage_impact"),
        )
    if segment_value is None:
        raise ValueError("a dimension needs one of its segments")
    wanted = text(df, dimension_column) == F.lit(str(segment_value))
    nothing = F.raise_error(
        F.lit(f"no numbers in '{metric_column}' where {dimension_column} is '{segment_value}'")
    ).cast("double")
    totals = df.agg(
        baseline.alias("baseline_total"),
        F.coalesce(F.sum(F.when(wanted, metric)), nothing).alias("baseline_segment"),
    )
    return _segment_impact(totals.withColumn("change_percentage", pct)).select(
        F.lit("segment").alias("scenario_type"),
        F.lit(metric_column).alias("metric_column"),
        F.lit(dimension_column).alias("dimension_column"),
        F.lit(str(segment_value)).alias("segment_value"),
        "baseline_total",
        "baseline_segment",
        "change_percentage",
        "projected_segment",
        "projected_total",
        "absolute_impact",
        "percentage_impact",
    )


def _segment_impact(totals: DataFrame) -> DataFrame:
    projected = _projected(F.col("baseline_segment"), F.col("change_percentage"))
    impact = projected - F.col("baseline_segment")
    share = F.round(F.try_divide(impact, F.col("baseline_total")) * 100, 10)
    return totals.select(
        "*",
        projected.alias("projected_segment"),
        (F.col("baseline_total") + impact).alias("projected_total"),
        impact.alias("absolute_impact"),
        F.coalesce(share, F.lit(0.0)).alias("percentage_impact"),
    )


def run_scenarios(
    df: DataFrame, metric_column: str, scenarios: Sequence[tuple[str, Any, float]]
) -> DataFrame:
    """Many (dimension, value, pct) scenarios from one pass over the table.

    Every scenario is judged on its own against the unchanged rest. A segment
    without values keeps NULL figures.
    """
    dimensions = list(dict.fromkeys(d for d, _, _ in scenarios))
    require_columns(df, [metric_column, *dimensions])
    table = df.sparkSession.createDataFrame(
        [(d, str(v), _check_pct(p)) for d, v, p in scenarios],
        "dimension_column string, segment_value string, change_percentage double",
    )
    metric = number(df, metric_column)
    segments = (
        df.select(
            metric.alias("metric"),
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(d).alias("dimension_column"),
                            text(df, d).alias("segment_value"),
                        )
                        for d in dimensions
                    ]
                )
            ),
        )
        .na.drop()
        .groupBy("dimension_column", "segment_value")
        .agg(F.sum("metric").alias("baseline_segment"))
    )
    total = df.agg(F.sum(metric).alias("total")).scalar()
    totals = table.join(segments, ["dimension_column", "segment_value"], "left")
    return _segment_impact(totals.withColumn("baseline_total", total))
