import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.functions import coerce, periods


def test_numbers_from_text(spark):
    df = spark.createDataFrame(
        [("12",), (" 5.5 ",), ("1e3",), ("1d",), ("n/a",), ("NaN",), ("",), (None,), ("-.5",)],
        "x string",
    )
    got = [r[0] for r in df.select(coerce.number(df, "x")).collect()]
    assert got == [12.0, 5.5, 1000.0, None, None, None, None, None, -0.5]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in coerce.nan_to_null(df).collect()] == [None, 1.0]
    assert df.agg(F.count_if(coerce.missing(df, "x"))).first()[0] == 1


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-01-05", dt.datetime(2026, 1, 5)),
        ("2026-01-05T06:07:08", dt.datetime(2026, 1, 5, 6, 7, 8)),
        ("3/4/2025", dt.datetime(2025, 3, 4)),
        ("Mar 4, 2025", dt.datetime(2025, 3, 4)),
        ("2025/03/04", dt.datetime(2025, 3, 4)),
        ("12:30", None),
        ("2024", None),
        ("2026-02-30", None),
        ("North", None),
    ],
)
def test_timestamps_from_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(coerce.timestamp(df, "x")).first()[0] == expected


@pytest.mark.parametrize(
    "period, label",
    [
        ("D", "2026-07-20"),
        ("W", "2026-07-20/2026-07-26"),
        ("M", "2026-07"),
        ("Q", "2026Q3"),
        ("Y", "2026"),
    ],
)
def test_period_labels(spark, period, label):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-07-20 10:00:00' AS ts")
    start = periods.period_start(F.col("ts"), period)
    assert df.select(periods.period_label(start, period)).first()[0] == label


def test_next_start():
    assert periods.next_start(dt.date(2026, 12, 1), "M") == dt.date(2027, 1, 1)
    assert periods.next_start(dt.date(2026, 10, 1), "Q") == dt.date(2027, 1, 1)
    assert periods.next_start(dt.date(2026, 7, 20), "W") == dt.date(2026, 7, 27)


def test_unknown_column_and_period(sales):
    with pytest.raises(ValueError, match="does not exist"):
        coerce.require_columns(sales, ["nope"])
    with pytest.raises(ValueError):
        periods.check_period("H")
