"""Linear trend of many series, and additive Holt-Winters of one array of values.

``linear_trend`` takes a regular series (keys, step, value) and returns keys,
step, fitted: in-sample steps first, then ``periods`` more. Holt-Winters of
series of any length is in ``smoothing``; this is its arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.coerce import ref
from tablewright.functions.joins import join_null_safe

# Season length and the shortest series that gets one.
SEASON = 7
SEASONAL_FROM = 14


def linear_trend(series: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    """Least-squares line over the step number, extended by ``periods`` steps."""
    by = [ref(k) for k in keys]
    x = F.col("step").cast("double")
    lines = series.groupBy(*by).agg(
        F.regr_slope("value", x).alias("slope"),
        F.regr_intercept("value", x).alias("intercept"),
        F.max("step").alias("last_step"),
    )
    ahead = F.sequence(F.col("last_step") + 1, F.col("last_step") + F.lit(periods))
    steps = join_null_safe(series.select(*by, "step"), lines, keys).drop("last_step")
    future = lines.select(*by, F.explode(ahead).alias("step"), "slope", "intercept")
    return steps.unionByName(future).select(
        *by, "step", (F.col("intercept") + F.col("slope") * F.col("step")).alias("fitted")
    )


def start_state(y: np.ndarray, season: int) -> np.ndarray:
    """Level, trend and seasons before the first of ``y``, from its first two seasons."""
    if season:
        first, second = y[:season].mean(), y[season : 2 * season].mean()
        trend = (second - first) / season
        # The level is the trend line just before the first point.
        level = first - trend * (season + 1) / 2
        line = level + trend * np.arange(1, season + 1)
        return np.array([level, trend, *(y[:season] - line)])
    trend = float(np.polyfit(np.arange(min(len(y), 10)), y[:10], 1)[0])
    return np.array([y[0] - trend, trend, 0.0])


def run(
    y: np.ndarray, season: int, weights: np.ndarray, state: np.ndarray, first: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smooth ``y``, whose first value is step ``first`` of its series.

    ``weights``: (3, sets). ``state``: (2 + seasons, sets) or (2 + seasons,).
    Returns the squared error of each set, and the fitted values of the last
    set and the state after the last value.
    """
    a, b, g = weights
    level, trend, *_ = state
    seasonal = state[2:].copy()
    if state.ndim == 1:
        level, trend = np.full(a.shape, level), np.full(a.shape, trend)
        seasonal = np.repeat(seasonal[:, None], len(a), axis=1)
    error = np.zeros(a.shape)
    fitted = np.empty(len(y))
    with np.errstate(over="ignore", invalid="ignore"):
        for t, actual in enumerate(y):
            at = (first + t) % len(seasonal)
            cycle = seasonal[at].copy()
            expected = level + trend + cycle
            fitted[t] = expected[-1]
            error += (actual - expected) ** 2
            moved = a * (actual - cycle) + (1 - a) * (level + trend)
            trend = b * (moved - level) + (1 - b) * trend
            if season:
                seasonal[at] = g * (actual - moved) + (1 - g) * cycle
            level = moved
    # Weights that let errors grow without bound lose.
    error = np.where(np.isnan(error), np.inf, error)
    return error, fitted, np.stack([level, trend, *seasonal])


def transition(y: np.ndarray, season: int, weights: np.ndarray, first: int) -> np.ndarray:
    """The affine map of the state over ``y``: (2 + season, 3 + season, sets), the constant last."""
    a, b, g = weights
    size = 2 + season
    maps = np.zeros((size, size + 1, len(a)))
    maps[np.arange(size), np.arange(size)] = 1.0
    level, trend, seasonal = maps[0], maps[1], maps[2:]
    with np.errstate(over="ignore", invalid="ignore"):
        for t, actual in enumerate(y):
            at = (first + t) % season
            cycle = seasonal[at]
            moved = (1 - a) * (level + trend) - a * cycle
            moved[-1] += a * actual
            trend = b * (moved - level) + (1 - b) * trend
            cycle = (1 - g) * cycle - g * moved
            cycle[-1] += g * actual
            seasonal[at] = cycle
            level = moved
    return np.concatenate([level[None], trend[None], seasonal])


def applied(maps: np.ndarray, state: np.ndarray) -> np.ndarray:
    """``maps`` of a :func:`transition` on a state (2 + season, sets)."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.einsum("ijp,jp->ip", maps[:, :-1], state) + maps[:, -1]


def composed(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        both = np.einsum("ijp,jkp->ikp", later[:, :-1], earlier)
    both[:, -1] += later[:, -1]
    return both


#: The search for weights: rounds, the first centre and width, and how much the width shrinks.
ROUNDS, CENTRE, WIDTH, SHRINK = 4, (0.5, 0.5, 0.5), 0.49, 2.5


def grid(centre: np.ndarray, width: float, season: int) -> np.ndarray:
    """(3, sets): five values of each weight around ``centre``."""
    axes = [np.clip(np.linspace(c - width, c + width, 5), 0.001, 0.999) for c in centre]
    if not season:
        axes[2] = np.array([0.0])
    return np.stack(np.meshgrid(*axes, indexing="ij")).reshape(3, -1)


def ahead(state: np.ndarray, length: int, periods: int) -> np.ndarray:
    """Forecasts from the state (2 + seasons,) after ``length`` values."""
    steps = np.arange(1, periods + 1)
    cycle = state[2:]
    return state[0] + state[1] * steps + cycle[(length + steps - 1) % len(cycle)]


def smooth(y: np.ndarray, periods: int, weights: Sequence[float] | None = None) -> np.ndarray:
    """Fitted values of ``y`` followed by ``periods`` forecasts.

    Unless given, smoothing weights come from a grid that is refined around its best point.
    """
    season = SEASON if len(y) >= SEASONAL_FROM else 0
    state = start_state(y, season)
    centre, width = np.array(weights or CENTRE, float), WIDTH
    for _ in range(0 if weights else ROUNDS):
        sets = grid(centre, width, season)
        error, *_ = run(y, season, sets, state)
        centre, width = sets[:, int(np.argmin(error))], width / SHRINK
    _, fitted, state = run(y, season, centre.reshape(3, 1), state)
    return np.concatenate([fitted, ahead(state[:, 0], len(y), periods)])
