"""Tables of a dataset report, written as Parquet or CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.functions.coerce import ref, require_columns, text
from tablewright.operators.profile import Profile, profile
from tablewright.operators.stats import describe

DATA_ROWS = 5000


def report_tables(
    df: DataFrame, profiled: Profile | None = None, order_by: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """data (first 5000 rows), summary, columns and, with numbers, statistics."""
    require_columns(df, order_by)
    found = profiled or profile(df)
    spark = df.sparkSession
    head = df.orderBy(*[ref(c) for c in order_by]) if order_by else df
    tables = {
        "data": head.limit(DATA_ROWS),
        "summary": found.summary_df(spark),
        "columns": found.to_df(spark),
    }
    if found.numerical_columns:
        tables["statistics"] = describe(df, found.numerical_columns)
    return tables


def write_report(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table below ``folder`` under its own name; CSV gets lists as JSON text."""
    if kind not in ("parquet", "csv"):
        raise ValueError("kind must be 'parquet' or 'csv'")
    for name, table in tables.items():
        target = f"{folder.rstrip('/')}/{name}"
        if kind == "parquet":
            table.write.mode("overwrite").parquet(target)
        else:
            flat = table.select(*[text(table, c).alias(c) for c in table.columns])
            flat.write.mode("overwrite").option("header", True).csv(target)
