"""Cleaning: duplicate rows and missing values, with a log of the steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.durable import written
from tablewright.functions.coerce import (
    groupable,
    has_map,
    is_numeric,
    is_text,
    long_form,
    missing,
    nan_to_null,
    ref,
    require_columns,
)
from tablewright.operators.ordering import forward_fill
from tablewright.operators.profile import inferred_types
from tablewright.operators.quantiles import column_quantiles

STRATEGIES = ("auto", "drop_rows", "drop_columns", "zero", "mean", "median", "mode")
PLACEHOLDER = "Unknown"


@dataclass(frozen=True)
class Cleaned:
    df: DataFrame
    steps: list[str]
    rows_before: int
    rows_after: int

    def log_df(self) -> DataFrame:
        """step, message, rows_before, rows_after."""
        return self.df.sparkSession.createDataFrame(
            [
                (i, message, self.rows_before, self.rows_after)
                for i, message in enumerate(self.steps)
            ],
            "step int, message string, rows_before long, rows_after long",
        )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of each group of equal rows; copies collapse before the shuffle.

    Rows are equal as in :func:`duplicate_count`. Columns that hold maps cannot
    be grouped themselves, so a comparable form stands for them.
    """
    keys = {
        f"__key{i}": groupable(df, f.name)
        for i, f in enumerate(df.schema.fields)
        if has_map(f.dataType) or isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not keys:
        return df.dropDuplicates()
    named = dict(zip(keys, [f.name for f in df.schema.fields if has_map(f.dataType) or isinstance(f.dataType, (T.FloatType, T.DoubleType))]))
    plain = [c for c in df.columns if c not in named.values()]
    return df.withColumns(keys).dropDuplicates([*plain, *keys]).select(*[ref(c) for c in df.columns])


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and its most frequent value as text, the smallest on ties.

    Values are counted map-side and hashed by (column, value), so neither a
    frequent value nor a wide column is gathered in one task.
    """
    counts = (
        long_form(df, list(columns))
        .na.drop(subset=["value"])
        .groupBy("column", "number", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counts.groupBy("column").agg(
        F.min(F.struct(-F.col("rows"), F.col("number"), F.col("value")))["value"].alias("mode")
    )


def clean(
    df: DataFrame,
    drop_duplicates: bool = True,
    missing_strategy: str = "auto",
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
) -> Cleaned:
    """Deduplicate, then treat the missing values of every target column.

    ``auto`` takes the median of numerical columns and the mode of others.
    A strategy that does not fit a column's type falls back to the mode, or
    to a forward fill in ``order_by`` order for datetime columns.
    """
    if missing_strategy not in STRATEGIES:
        raise ValueError(f"Unknown missing_strategy '{missing_strategy}'")
    require_columns(df, order_by)
    table = nan_to_null(df)
    rows_before = table.count()
    rows = rows_before
    steps: list[str] = []
    if drop_duplicates:
        table = written(drop_duplicate_rows(table))
        rows = table.count()
        steps.append(f"Dropped {rows_before - rows} duplicate rows")

    targets = [c for c in (columns or table.columns) if c in table.columns]
    gaps = _missing_counts(table, targets)
    targets = [c for c in targets if gaps[c]]
    if not targets:
        return Cleaned(table, steps, rows_before, rows)

    if missing_strategy == "drop_rows":
        dropped = _rows_dropped(table, targets)
        steps += [
            f"Dropped {n} rows with missing '{c}'" for c, n in zip(targets, dropped) if n
        ]
        table = table.na.drop(subset=targets)
        return Cleaned(table, steps, rows_before, rows - sum(dropped))
    if missing_strategy == "drop_columns":
        steps += [f"Dropped column '{c}' (too many missing values)" for c in targets]
        return Cleaned(table.drop(*targets), steps, rows_before, rows)

    filled, more = _fill(table, targets, missing_strategy, order_by)
    return Cleaned(filled, steps + more, rows_before, rows)


def _missing_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def _rows_dropped(df: DataFrame, columns: Sequence[str]) -> list[int]:
    """Rows each column removes when the columns are treated one after another."""
    kept: Column = F.lit(True)
    folds = []
    for i, c in enumerate(columns):
        folds.append(F.count_if(kept & ref(c).isNull()).alias(f"d{i}"))
        kept = kept & ref(c).isNotNull()
    row = df.agg(*folds).first()
    return [row[f"d{i}"] for i in range(len(columns))]


def _fill(
    df: DataFrame, targets: Sequence[str], strategy: str, order_by: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """All fill values from at most three aggregates, then one projection."""
    kinds = {} if strategy == "zero" else inferred_types(df, targets)
    plan: dict[str, str] = {}
    for c in targets:
        if strategy == "zero":
            plan[c] = "zero"
        elif kinds[c] == "numerical" and strategy in ("auto", "median"):
            plan[c] = "median"
        elif kinds[c] == "numerical" and strategy == "mean":
            plan[c] = "mean"
        elif kinds[c] == "datetime" and strategy not in ("auto", "mode"):
            plan[c] = "forward"
        else:
            plan[c] = "mode"
    by_step = {s: [c for c in targets if plan[c] == s] for s in set(plan.values())}

    values: dict[str, Column] = {}
    steps: dict[str, str] = {}
    for c in by_step.get("zero", []):
        dtype = df.schema[c].dataType
        if is_numeric(dtype) or is_text(dtype) or isinstance(dtype, T.BooleanType):
            values[c] = F.lit(0).cast("string").cast(dtype)
            steps[c] = f"Filled missing '{c}' with 0"
        else:
            steps[c] = f"Left missing '{c}' unchanged: 0 is not a {dtype.simpleString()}"
    if by_step.get("mean"):
        row = df.agg(*[F.avg(ref(c)).alias(c) for c in by_step["mean"]]).first()
        for c in by_step["mean"]:
            values[c] = F.lit(row[c]).cast("double")
            steps[c] = f"Filled missing '{c}' with mean"
    if by_step.get("median"):
        for c, q in column_quantiles(df, by_step["median"], [0.5]).items():
            values[c] = F.lit(q[0] if q else None).cast("double")
            steps[c] = f"Filled missing '{c}' with median"
    if by_step.get("mode"):
        modes = {r["column"]: r["mode"] for r in column_modes(df, by_step["mode"]).collect()}
        for c in by_step["mode"]:
            value = modes.get(c, PLACEHOLDER)
            values[c] = F.lit(value).try_cast(df.schema[c].dataType)
            steps[c] = f"Filled missing '{c}' with mode ('{value}')"
    out = df.select(
        *[
            F.coalesce(_widened(df, c, plan[c]), values[c]).alias(c) if c in values else ref(c)
            for c in df.columns
        ]
    )
    if by_step.get("forward"):
        if not order_by:
            raise ValueError("forward fill needs order_by: rows have no order of their own")
        out = forward_fill(out, by_step["forward"], order_by)
        steps.update({c: f"Forward-filled missing '{c}'" for c in by_step["forward"]})
    return out, [steps[c] for c in targets]


def _widened(df: DataFrame, column: str, step: str) -> Column:
    """Means and medians are not whole numbers, so integer columns widen."""
    return ref(column).cast("double") if step in ("mean", "median") else ref(column)
