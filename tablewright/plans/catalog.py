"""All registered queries."""

from tablewright.plans import decisions, models, summaries, tables  # noqa: F401
from tablewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
