import datetime as dt

import numpy as np
import pytest

from tablewright.forecast import models, smoothing
from tablewright.forecast import prepare as preparing
from tablewright.forecast.prepare import prepare
from tablewright.forecast.report import run_forecast

DAY = dt.datetime(2024, 1, 1)
KINDS = "k string, d timestamp_ntz, v double"


@pytest.fixture(scope="module")
def stray(spark):
    """Daily series, of which "b" has one date 276 years later."""
    rows = [(k, DAY + dt.timedelta(days=i), float(i)) for k in "ab" for i in range(10)]
    return spark.createDataFrame([*rows, ("b", dt.datetime(2300, 1, 1), 5.0)], KINDS)


def test_linear_trend_takes_every_length(stray):
    steps = (dt.datetime(2300, 1, 1) - DAY).days + 1
    assert steps > 100_000
    found = run_forecast(stray, "d", "v", 3, ["k"], "linear_trend")
    assert {r.k: r.available for r in found.summary.collect()} == {"a": True, "b": True}
    assert {r.k: r.available for r in found.evaluation.collect()} == {"a": True, "b": True}
    ahead = {(r.k, r.horizon): r for r in found.forecast.collect()}
    assert len(ahead) == 6 and ahead["b", 1].ts == dt.datetime(2300, 1, 2)
    values = np.interp(np.arange(steps), [*range(10), steps - 1], [*range(10), 5.0])
    slope, intercept = np.polyfit(np.arange(steps), values, 1)
    assert ahead["b", 3].value == pytest.approx(intercept + slope * (steps + 2), rel=1e-6)
    alone = run_forecast(stray.where("k = 'b'"), "d", "v", 3, method="linear_trend")
    assert alone.forecast.count() == 3


def plain_run(y, weights, state, periods):
    """Holt-Winters of one set of weights, a step at a time."""
    (a, b, g), (level, trend, *cycle), fitted = weights, state, []
    for t in range(len(y) + periods):
        season = cycle[t % len(cycle)]
        if t >= len(y):
            fitted.append(level + trend * (t - len(y) + 1) + season)
            continue
        fitted.append(level + trend + season)
        before, level = level, a * (y[t] - season) + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        cycle[t % len(cycle)] = g * (y[t] - level) + (1 - g) * season
    return fitted


@pytest.fixture(scope="module")
def waves(spark):
    """Series of several lengths, one of them under a NULL key."""
    rng, values = np.random.default_rng(4), {}
    for key, n in {"short": 9, "one": 14, "two": 40, "many": 700, None: 333}.items():
        t = np.arange(n)
        values[key] = 50 + 0.1 * t + 8 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n)
    rows = [(k, i, float(v), n) for k, y in values.items() for i, v in enumerate(y) for n in [len(y)]]
    return values, spark.createDataFrame(rows, "k string, step long, value double, steps long").repartition(4)


def fitted_by_key(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.k, []).append((r.step, r.fitted))
    assert all([s for s, _ in sorted(x)] == list(range(len(x))) for x in found.values())
    return {k: [v for _, v in sorted(x)] for k, x in found.items()}


@pytest.mark.parametrize("fan, slice_steps", [(32, 10_000), (3, 20)])
def test_smoothing_in_slices_equals_one_pass(waves, monkeypatch, fan, slice_steps):
    monkeypatch.setattr(smoothing, "FAN", fan)
    values, series = waves
    found = fitted_by_key(smoothing.holt_winters(series, ["k"], 5, slice_steps=slice_steps))
    assert set(found) == set(values)
    for k, y in values.items():
        assert found[k] == pytest.approx(models.smooth(y, 5), rel=1e-6), k


def test_fixed_weights(waves, monkeypatch):
    monkeypatch.setattr(smoothing, "FAN", 2)
    values, series = waves
    weights = (0.3, 0.1, 0.2)
    found = fitted_by_key(smoothing.holt_winters(series.where("steps >= 14"), ["k"], 9, weights, 14))
    for k, y in values.items():
        if len(y) >= 14:
            assert found[k] == pytest.approx(plain_run(y, weights, models.start_state(y, 7), 9), rel=1e-9), k


def test_transitions_compose_and_equal_the_run():
    rng = np.random.default_rng(6)
    y, weights = rng.normal(size=61), models.grid(np.array(models.CENTRE), models.WIDTH, 7)
    state = np.repeat(models.start_state(y, 7)[:, None], weights.shape[1], axis=1)
    whole = models.run(y, 7, weights, state)[2]
    first, second = (models.transition(p, 7, weights, at) for p, at in ((y[:25], 0), (y[25:], 25)))
    stable = np.abs(whole).max(axis=0) < 1e6
    assert stable.sum() > 50
    for found in (models.applied(models.composed(second, first), state), models.applied(second, models.applied(first, state))):
        assert found[:, stable] == pytest.approx(whole[:, stable], rel=1e-6, abs=1e-6)


def test_holt_winters_takes_every_length(stray):
    """100,807 days, of which all but ten are filled in: eleven slices."""
    found = run_forecast(stray, "d", "v", 3, ["k"])
    assert {r.k: r.available for r in found.summary.collect()} == {"a": True, "b": True}
    assert {r.k: r.available for r in found.evaluation.collect()} == {"a": True, "b": True}
    ahead = [r.value for r in found.forecast.where("k = 'b'").orderBy("horizon").collect()]
    assert ahead == pytest.approx([5.0] * 3, abs=0.01)


def test_slices_hold_two_seasons(waves):
    with pytest.raises(ValueError, match="slice_steps"):
        smoothing.holt_winters(waves[1], ["k"], 1, slice_steps=13)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_slices_change_nothing(spark, monkeypatch, size):
    rng = np.random.default_rng(5)
    days = np.flatnonzero(rng.random(60) < 0.3)
    rows = [(k, DAY + dt.timedelta(days=int(i)), float(rng.integers(9))) for k in ("a", "b", None) for i in days]
    table = spark.createDataFrame([*rows, ("a", DAY, 1.0), ("a", DAY + dt.timedelta(days=1), 1.0)], KINDS)
    whole = sorted(map(str, prepare(table, "d", "v", ["k"]).series.collect()))
    monkeypatch.setattr(preparing, "SLICE_STEPS", size)
    assert sorted(map(str, prepare(table, "d", "v", ["k"]).series.collect())) == whole


GAPS = ["observed", "rows", "first_slot", "last_slot", "first_month", "last_month", "min_gap", "max_gap"]


@pytest.mark.parametrize("size", [1, 4, 50_000])
def test_gaps_in_slices_equal_one_pass(spark, monkeypatch, size):
    monkeypatch.setattr(preparing, "GAP_SLOTS", size)
    rng = np.random.default_rng(6)
    series = {k: np.sort(rng.choice(400, n, replace=False)) for k, n in {"a": 90, "b": 2, "c": 1, None: 37}.items()}
    rows = [(k, DAY + dt.timedelta(days=int(i)), 1.0) for k, days in series.items() for i in days]
    slots = preparing.slot_means(spark.createDataFrame(rows, KINDS), "d", "v", ["k"])
    found = {r.k: r for r in preparing.frequencies(slots, ["k"]).collect()}
    assert set(found) == set(series)
    for k, days in series.items():
        dates = [DAY + dt.timedelta(days=int(i)) for i in days]
        slot = [(d - dt.datetime(1970, 1, 1)).days for d in dates]
        months = [d.year * 12 + d.month for d in dates]
        gaps, month_gaps = np.diff(slot), np.diff(months)
        ends = (min(gaps), max(gaps)) if len(gaps) else (None, None)
        expected = (len(days), len(days), slot[0], slot[-1], months[0], months[-1], *ends)
        assert tuple(found[k][c] for c in GAPS) == expected
        assert found[k].median_gap == (np.median(gaps) if len(gaps) else None)
        assert found[k].max_month_gap == (max(month_gaps) if len(gaps) else None)
        assert found[k].same_day == (len({d.day for d in dates}) == 1)


def test_a_long_series_is_cut_for_its_gaps(spark):
    """Ten million minutes of one series: no task orders more than a slice of them."""
    slots = spark.range(0, 10_000_000, 1, 16).selectExpr(
        "0 AS k",
        "id * 2 AS slot",
        "timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, id * 2) AS ts",
        "1L AS rows",
    )
    row = preparing.frequencies(slots, ["k"], "minute").first()
    assert (row.observed, row.min_gap, row.max_gap, row.median_gap, row.stride) == (10_000_000, 2, 2, 2.0, 2)
    plan = slots._sc._jvm.PythonSQLUtils.explainString(
        preparing.frequencies(slots, ["k"], "minute")._jdf.queryExecution(), "simple"
    )
    ordered = [line for line in plan.splitlines() if "Window [" in line and "lag(slot" in line]
    assert ordered and all("cut" in line for line in ordered)
