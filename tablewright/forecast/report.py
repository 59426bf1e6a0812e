"""Forecast report: history, forecast with interval, backtest and summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.forecast.models import linear_trend
from tablewright.forecast.prepare import ALL, MIN_OBSERVATIONS, prepare, step_time
from tablewright.forecast.smoothing import holt_winters
from tablewright.functions.coerce import ref
from tablewright.functions.joins import join_null_safe

MAX_PERIODS = 730
HISTORY_POINTS = 180
HOLDOUT_LIMIT = 14
HOLDOUT_FRACTION = 5
MIN_RESIDUALS = 5
NORMAL_95 = 1.96

METHODS = ("holt_winters", "linear_trend")


@dataclass(frozen=True)
class Forecast:
    """Every table has the key columns of the series in front.

    history: ts, value. forecast: horizon, ts, value, lower, upper.
    evaluation: available, holdout_periods, mae, rmse, mape.
    summary: method, trend_direction, pct_change_projected, duplicate_rows,
    filled_steps, available.
    """

    history: DataFrame
    forecast: DataFrame
    evaluation: DataFrame
    summary: DataFrame


def holdout_size(steps):
    return F.greatest(
        F.lit(1),
        F.least(F.floor(steps / HOLDOUT_FRACTION), F.lit(HOLDOUT_LIMIT)),
    ).cast("long")


def fit(series: DataFrame, keys: Sequence[str], method: str, periods: int) -> DataFrame:
    """Fitted values and ``periods`` more."""
    if method == "holt_winters":
        return holt_winters(series, keys, periods)
    return linear_trend(series, keys, periods)


def evaluate(series: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """Refit without the last points of each series and compare with them."""
    by = [ref(k) for k in keys]
    split = series.withColumn("holdout", holdout_size(F.col("steps")))
    split = split.withColumn("enough", F.col("steps") - F.col("holdout") >= MIN_OBSERVATIONS)
    train = split.where(F.col("enough") & (F.col("step") < F.col("steps") - F.col("holdout")))
    held = split.where(F.col("enough") & (F.col("step") >= F.col("steps") - F.col("holdout")))
    predicted = fit(train, keys, method, HOLDOUT_LIMIT)
    compared = join_null_safe(held, predicted, [*keys, "step"])
    error = F.col("value") - F.col("fitted")
    scores = compared.groupBy(*by).agg(
        F.max("holdout").alias("holdout_periods"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(
            F.bool_and(F.col("value") != 0),
            F.avg(F.abs(F.try_divide(error, F.col("value")))) * 100,
        ).alias("mape"),
    )
    every = series.select(*by).distinct()
    return join_null_safe(every, scores, list(keys), "left").select(
        *by,
        F.col("mae").isNotNull().alias("available"),
        "holdout_periods",
        "mae",
        "rmse",
        "mape",
    )


def last_points(series: DataFrame, keys: Sequence[str], n: int = HISTORY_POINTS) -> DataFrame:
    """The latest ``n`` steps of each series."""
    by = [ref(k) for k in keys]
    newest = Window.partitionBy(*by).orderBy(F.col("step").desc())
    return (
        series.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= n)
        .select(*by, "step", "ts", "value")
    )


def run_forecast(
    df: DataFrame,
    date_column: str,
    target_column: str,
    periods: int = 30,
    keys: Sequence[str] = (),
    method: str = "holt_winters",
    grain: str = "day",
) -> Forecast:
    """Forecast one series, or one per value of ``keys``, of every length."""
    if periods is None or periods < 1:
        raise ValueError("periods must be 1 or more")
    if periods > MAX_PERIODS:
        raise ValueError(f"periods must be {MAX_PERIODS} or fewer")
    if method not in METHODS:
        raise ValueError(f"Unknown forecasting method '{method}'")
    prepared = prepare(df, date_column, target_column, keys, grain)
    series, by = prepared.series, prepared.keys
    columns = [ref(k) for k in by]

    fitted = written(fit(series, by, method, periods))
    residual = (
        join_null_safe(series, fitted, [*by, "step"])
        .groupBy(*columns)
        .agg(
            F.count(F.lit(1)).alias("residuals"),
            F.stddev_samp(F.col("value") - F.col("fitted")).alias("spread"),
            F.max_by("value", "step").alias("last_value"),
        )
    )
    shape = prepared.info.select(
        *columns, "unit", "stride", "first_ts", F.col("steps").alias("length"), "rows", "observed"
    )
    context = join_null_safe(shape, residual, by)
    future = join_null_safe(fitted, context, by).where(F.col("step") >= F.col("length"))
    horizon = F.col("step") - F.col("length") + 1
    usable = (F.col("residuals") >= MIN_RESIDUALS) & (F.col("spread") > 0)
    margin = F.when(usable, F.lit(NORMAL_95) * F.col("spread") * F.sqrt(horizon))
    forecast = future.select(
        *columns,
        horizon.cast("int").alias("horizon"),
        step_time(F.col("step"), grain).alias("ts"),
        F.col("fitted").alias("value"),
        (F.col("fitted") - margin).alias("lower"),
        (F.col("fitted") + margin).alias("upper"),
    )
    ends = future.groupBy(*columns).agg(
        F.max_by("fitted", "step").alias("end_value"), F.max("last_value").alias("last_value")
    )
    filled = series.groupBy(*columns).agg(F.count_if(~F.col("observed")).alias("filled_steps"))
    change = F.col("end_value") - F.col("last_value")
    every = prepared.info.select(
        *columns, (F.col("rows") - F.col("observed")).alias("duplicate_rows")
    )
    summary = join_null_safe(join_null_safe(every, ends, by, "left"), filled, by, "left").select(
        *columns,
        F.lit(method).alias("method"),
        F.col("end_value").isNotNull().alias("available"),
        F.when(change > 0, "upward")
        .when(change.isNotNull(), "downward")
        .alias("trend_direction"),
        (F.try_divide(change, F.abs(F.col("last_value") + F.lit(1e-9))) * 100).alias(
            "pct_change_projected"
        ),
        "duplicate_rows",
        "filled_steps",
    )
    tables = (
        last_points(series, by).drop("step"),
        forecast,
        evaluate(series, by, method),
        summary,
    )
    return Forecast(*[t if keys else t.drop(ALL) for t in tables])
