"""Plain findings about a table, from its profile and statistics.

Inputs have one row per column (or at most five pairs), so they are read to
the driver; the scans behind them run on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.operators.profile import Profile, profile
from tablewright.operators.stats import iqr_outliers, skewness, strongest_pairs

# Thresholds of the rules.
MISSING_PCT = 5
SKEW = 1
CORRELATION = 0.5
CORRELATED_PAIRS = 3
OUTLIER_PCT = 1
WORST_COLUMNS = 3

_SCHEMA = "position int, type string, title string, detail string"


def generate_insights(df: DataFrame, profiled: Profile | None = None) -> DataFrame:
    """position, type, title, detail; one "clean" row when no rule fires."""
    # Types, gaps and copies alone are told here; they are exact without the distinct values.
    found = profiled or profile(df, exact_distinct=None)
    numerical = found.numerical_columns
    rows: list[tuple[str, str, str]] = []
    if found.missing_pct > MISSING_PCT:
        worst = sorted(found.columns, key=lambda c: -c.missing_pct)[:WORST_COLUMNS]
        rows.append(
            (
                "data_quality",
                "Missing data detected",
                f"{found.missing_pct}% of all cells are missing; most affected: "
                + ", ".join(c.name for c in worst),
            )
        )
    if found.duplicate_count:
        share = round(found.duplicate_count / max(found.row_count, 1) * 100, 1)
        rows.append(
            (
                "data_quality",
                "Duplicate rows found",
                f"{found.duplicate_count} duplicate rows ({share}% of the dataset)",
            )
        )
    if numerical:
        rows += _skewed(df, numerical) + _correlated(df, numerical) + _outliers(df, numerical)
    if not rows:
        rows.append(("summary", "Dataset looks clean", "No rule found anything to report"))
    return df.sparkSession.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], _SCHEMA
    )


def _in_order(table: DataFrame, columns: list[str]) -> list:
    return sorted(table.collect(), key=lambda r: columns.index(r["column"]))


def _skewed(df: DataFrame, columns: list[str]) -> list[tuple[str, str, str]]:
    return [
        (
            "distribution",
            f"'{r['column']}' is skewed",
            f"{'right' if r['skew'] > 0 else 'left'}-skewed (skew={round(r['skew'], 2)})",
        )
        for r in _in_order(skewness(df, columns), columns)
        if r["skew"] and abs(r["skew"]) > SKEW
    ]


def _correlated(df: DataFrame, columns: list[str]) -> list[tuple[str, str, str]]:
    return [
        (
            "correlation",
            f"'{r['column_a']}' and '{r['column_b']}' are strongly correlated",
            f"{r['direction']} (r={round(r['r'], 2)})",
        )
        for r in strongest_pairs(df, columns, CORRELATED_PAIRS, CORRELATION).collect()
    ]


def _outliers(df: DataFrame, columns: list[str]) -> list[tuple[str, str, str]]:
    return [
        (
            "outliers",
            f"Outliers detected in '{r['column']}'",
            f"{r['count']} values ({r['pct']}%) outside "
            f"[{round(r['lower_bound'], 4)}, {round(r['upper_bound'], 4)}]",
        )
        for r in _in_order(iqr_outliers(df, columns), columns)
        if r["count"] and r["pct"] > OUTLIER_PCT
    ]
