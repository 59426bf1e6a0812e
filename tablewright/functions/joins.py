"""Joins that treat NULL keys as equal, as grouping does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.coerce import ref


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi join on ``keys`` with NULL = NULL; keeps the left key columns."""
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = {k: f"_right_{i}" for i, k in enumerate(keys)}
    other = right.select(*[ref(c).alias(renamed.get(c, c)) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & ref(k).eqNullSafe(F.col(renamed[k]))
    return left.join(other, condition, how).drop(*renamed.values())
