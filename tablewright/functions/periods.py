"""Calendar periods: D(ay), W(eek from Monday), M(onth), Q(uarter), Y(ear).

A period is keyed by the DATE it starts on. Keys come from date arithmetic
only, so they do not depend on the session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("D", "W", "M", "Q", "Y")
_TRUNC_UNIT = {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_STEP = {
    "D": "interval 1 day",
    "W": "interval 7 days",
    "M": "interval 1 month",
    "Q": "interval 3 months",
    "Y": "interval 1 year",
}


def check_period(period: str) -> str:
    if period not in PERIODS:
        raise ValueError("period must be D, W, M, Q, or Y")
    return period


def period_start(ts: Column, period: str) -> Column:
    """First day of the period holding ``ts``, as DATE."""
    day = ts.cast("date")
    return day if check_period(period) == "D" else F.trunc(day, _TRUNC_UNIT[period])


def period_label(start: Column, period: str) -> Column:
    """Text of a period key: 2026-07-20, 2026-07-06/2026-07-12, 2026-07, 2026Q3, 2026."""
    if check_period(period) == "D":
        return F.date_format(start, "yyyy-MM-dd")
    if period == "W":
        return F.concat(
            F.date_format(start, "yyyy-MM-dd"),
            F.lit("/"),
            F.date_format(F.date_add(start, 6), "yyyy-MM-dd"),
        )
    if period == "M":
        return F.date_format(start, "yyyy-MM")
    if period == "Q":
        return F.concat(
            F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string")
        )
    return F.date_format(start, "yyyy")


def calendar(first: Column, last: Column, period: str) -> Column:
    """Array of every period key from ``first`` to ``last``."""
    return F.sequence(first, last, F.expr(_STEP[check_period(period)]))


def next_start(start: dt.date, period: str) -> dt.date:
    """First day of the following period, for one driver-side date."""
    if check_period(period) in ("D", "W"):
        return start + dt.timedelta(days=1 if period == "D" else 7)
    months = {"M": 1, "Q": 3, "Y": 12}[period]
    index = start.year * 12 + (start.month - 1) + months
    return dt.date(index // 12, index % 12 + 1, 1)


def timestamp_text(ts: Column) -> Column:
    """Date only at midnight, else ISO 8601 with the time of day."""
    midnight = ts.cast("date").cast("timestamp_ntz")
    return (
        F.when(ts == midnight, F.date_format(ts, "yyyy-MM-dd"))
        .when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )
