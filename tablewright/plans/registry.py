"""Where queries and named operators are registered."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.forecast.report import run_forecast
from tablewright.ml.cluster import run_clustering
from tablewright.ml.supervised import explain_model, run_classification, run_regression
from tablewright.operators.profile import dataset_summary, profile
from tablewright.operators.query import aggregate, group_by, trend
from tablewright.operators.recommend import generate_recommendations
from tablewright.operators.rootcause import root_cause
from tablewright.operators.whatif import run_what_if

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Operators that can be run by name on a table.
OPERATORS: dict[str, Callable[..., Any]] = {
    "dataset_summary": dataset_summary,
    "dataset_profile": profile,
    "aggregate": aggregate,
    "group_by": group_by,
    "trend": trend,
    "root_cause": root_cause,
    "recommendation": generate_recommendations,
    "what_if": run_what_if,
    "forecast": run_forecast,
    "classification": run_classification,
    "regression": run_regression,
    "clustering": run_clustering,
    "explainability": explain_model,
}


def run_operator(df: DataFrame, name: str, arguments: dict[str, Any] | None = None) -> Any:
    """Run a named operator with keyword arguments."""
    if name not in OPERATORS:
        raise ValueError(f"Unknown operator '{name}'")
    return OPERATORS[name](df, **(arguments or {}))


class Tables:
    """The test tables of one folder, read on access: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with the SQL that must agree with it."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 2, **other: int) -> DataFrame:
    """Floating columns rounded, so both engines show sums in the same way."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), other.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
