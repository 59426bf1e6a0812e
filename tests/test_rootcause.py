import pytest

from tablewright.operators.rootcause import analyze_period_change, root_cause

APRIL_MAY = [
    ("2025-04-01", 100, "N"),
    ("2025-04-10", 200, "N"),
    ("2025-04-14", 300, "S"),
    ("2025-04-20", 400, "S"),
    ("2025-04-30", 500, "N"),
    ("2025-05-01", 120, "N"),
    ("2025-05-10", 220, "N"),
    ("2025-05-14", 330, "S"),
]


def totals(cause):
    row = cause.comparison.first()
    return row["previous_value"], row["current_value"], row["absolute_change"]


def test_full_month(spark):
    df = spark.createDataFrame(
        [
            ("2026-01-10", "North", 600),
            ("2026-01-15", "South", 400),
            ("2026-02-10", "North", 300),
            ("2026-02-15", "South", 350),
        ],
        "date string, region string, revenue long",
    )
    cause = analyze_period_change(df, "date", "revenue", ["region", "absent"])
    row = cause.comparison.first()
    assert totals(cause) == (1000, 650, -350)
    assert (row["percentage_change"], row["direction"]) == (-35.0, "decrease")
    assert (row["previous_period"], row["current_period"]) == ("2026-01", "2026-02")
    found = {r["value"]: r for r in cause.contributors.collect()}
    assert (found["North"]["change"], found["North"]["contribution_pct"]) == (-300, 85.71)
    assert found["South"]["change"] == -50
    assert cause.reconciliation.first()["error"] == 0
    assert [r["value"] for r in cause.top_contributors.collect()] == ["North", "South"]


def test_comparable_month(make_dated):
    cause = root_cause(make_dated(APRIL_MAY), "date", "sales", ["region"])
    assert totals(cause) == (600, 670, 70)
    assert cause.comparison.first()["percentage_change"] == 11.67
    quality = cause.quality.first()
    assert not quality["current_period_complete"]
    assert quality["warning"] and quality["current_period_last_day"] == 14
    assert (quality["previous_start"], quality["previous_end"]) == ("2025-04-01", "2025-04-14")


@pytest.mark.parametrize(
    "period, rows",
    [
        (
            "W",
            [(f"2026-07-{d:02d}", (d - 5) * 100) for d in range(6, 13)]
            + [("2026-07-13", 150), ("2026-07-14", 250), ("2026-07-15", 350)],
        ),
        (
            "Q",
            [
                ("2026-01-01", 100),
                ("2026-01-20", 200),
                ("2026-02-13", 300),
                ("2026-02-14", 400),
                ("2026-03-01", 500),
                ("2026-03-31", 600),
                ("2026-04-01", 150),
                ("2026-04-20", 250),
                ("2026-05-14", 350),
            ],
        ),
        (
            "Y",
            [
                ("2025-01-01", 100),
                ("2025-03-10", 200),
                ("2025-05-14", 300),
                ("2025-05-15", 400),
                ("2025-08-01", 500),
                ("2025-12-31", 600),
                ("2026-01-01", 150),
                ("2026-03-10", 250),
                ("2026-05-14", 350),
            ],
        ),
    ],
)
def test_comparable_periods(make_dated, period, rows):
    assert totals(root_cause(make_dated(rows), "date", "sales", [], period)) == (600, 750, 150)


def test_date_only_day_is_complete(make_dated):
    df = make_dated(
        [("2026-07-20", v) for v in (100, 200, 300)] + [("2026-07-21", v) for v in (150, 250, 350)]
    )
    cause = root_cause(df, "date", "sales", ["region"], "D")
    assert totals(cause) == (600, 750, 150)
    assert cause.quality.first()["current_period_complete"]
    assert cause.quality.first()["warning"] is None


def test_intraday_comparable(make_dated):
    df = make_dated(
        [
            ("2026-07-20 08:00:00", 100),
            ("2026-07-20 10:00:00", 200),
            ("2026-07-20 18:00:00", 400),
            ("2026-07-21 09:00:00", 50),
            ("2026-07-21 10:00:00", 70),
        ]
    )
    cause = root_cause(df, "date", "sales", ["region"], "D")
    assert totals(cause) == (300, 120, -180)
    assert cause.quality.first()["previous_end"] == "2026-07-20T10:00:00"


def test_full_and_comparable_differ(make_dated):
    rows = [("2026-04-01", 100), ("2026-04-10", 200), ("2026-04-14", 300), ("2026-04-20", 400)]
    rows += [("2026-04-30", 500), ("2026-05-01", 150), ("2026-05-10", 250), ("2026-05-14", 350)]
    full = analyze_period_change(make_dated(rows), "date", "sales")
    assert totals(full) == (1500, 750, -750)
    assert not full.quality.first()["current_period_complete"]
    assert totals(root_cause(make_dated(rows), "date", "sales")) == (600, 750, 150)


def test_complete_month_is_not_cut(make_dated):
    rows = [("2026-04-01", 100), ("2026-04-10", 200), ("2026-04-20", 300), ("2026-04-30", 400)]
    rows += [("2026-05-01", 150), ("2026-05-10", 250), ("2026-05-20", 350), ("2026-05-31", 450)]
    cause = root_cause(make_dated(rows), "date", "sales")
    assert totals(cause) == (1000, 1200, 200)
    assert cause.quality.first()["current_period_complete"]


def test_short_previous_month_is_clamped(make_dated):
    rows = [("2026-02-01", 10), ("2026-02-28", 20), ("2026-03-01", 5), ("2026-03-30", 5)]
    assert totals(root_cause(make_dated(rows), "date", "sales")) == (30, 10, -20)


def test_zero_previous(make_dated):
    rows = [("2026-04-01", 0, "N"), ("2026-04-30", 0, "S")]
    rows += [("2026-05-01", 200, "N"), ("2026-05-31", 300, "S")]
    row = root_cause(make_dated(rows), "date", "sales", ["region"]).comparison.first()
    assert row["percentage_change"] is None and row["direction"] == "increase"


def test_offsetting_changes(make_dated):
    rows = [("2026-04-30", 400, "N"), ("2026-04-30", 600, "S")]
    rows += [("2026-05-31", 600, "N"), ("2026-05-31", 400, "S")]
    cause = root_cause(make_dated(rows), "date", "sales", ["region"])
    assert cause.comparison.first()["direction"] == "no_change"
    found = {r["value"]: (r["change"], r["contribution_pct"]) for r in cause.contributors.collect()}
    assert found == {"N": (200, 0.0), "S": (-200, 0.0)}


def test_null_dimension(make_dated):
    rows = [("2026-04-30", 400, "N"), ("2026-04-30", 600, None)]
    rows += [("2026-05-31", 500, "N"), ("2026-05-31", 300, None)]
    cause = root_cause(make_dated(rows), "date", "sales", ["region"])
    found = {r["value"]: (r["change"], r["contribution_pct"]) for r in cause.contributors.collect()}
    assert found == {"N": (100, -50.0), "Missing": (-300, 150.0)}


def test_one_sided_values_and_older_periods(make_dated):
    rows = [("2026-01-01", 9, "old"), ("2026-04-30", 4, "gone"), ("2026-06-30", 6, "new")]
    cause = analyze_period_change(make_dated(rows), "date", "sales", ["region"])
    found = {r["value"]: (r["previous_value"], r["current_value"]) for r in cause.contributors.collect()}
    assert found == {"gone": (4, 0), "new": (0, 6)}
    assert cause.comparison.first()["previous_period"] == "2026-04"


def test_rejects(make_dated):
    df = make_dated([("2026-04-30", 1)])
    with pytest.raises(ValueError, match="two periods"):
        root_cause(df, "date", "sales")
    with pytest.raises(ValueError, match="no row has"):
        root_cause(df, "region", "sales")
    for bad in ({"period": "H"}, {"comparison_mode": "x"}, {"metric_column": "x"}):
        with pytest.raises(ValueError):
            analyze_period_change(**{"df": df, "date_column": "date", "metric_column": "sales", **bad})
