"""Additive Holt-Winters for many series of any length.

A series is cut into slices of ``SLICE_STEPS`` steps, each a row with its
values. For fixed weights the state (level, trend, seven seasons) follows an
affine map of the state before, and maps compose. So each slice yields one
small matrix for each set of weights; the products of the matrices before a
slice, formed in a tree of ``FAN`` children, give its start; and a second pass
over the slices gives squared errors, whose sums decide between the sets. Four
rounds refine the weights, a last pass gives the fitted values. No task holds
more than a slice, or ``FAN`` matrices. Series of one slice are fitted where
their slice is, by the same arithmetic in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.durable import written
from tablewright.forecast import models
from tablewright.forecast.models import SEASON
from tablewright.functions.coerce import ref
from tablewright.functions.joins import join_null_safe

SLICE_STEPS = 10_000
#: Matrices that one task multiplies; with 125 sets of weights they take some 90 kB each.
FAN = 32
_STATE = 2 + SEASON


def holt_winters(
    series: DataFrame,
    keys: Sequence[str],
    periods: int,
    weights: Sequence[float] | None = None,
    slice_steps: int = SLICE_STEPS,
) -> DataFrame:
    """Additive trend, plus an additive season of 7 from 14 steps on: keys, step, fitted.

    ``series``: keys, step (0, 1, ...) and value. ``weights`` of level, trend
    and season are searched for each series unless given. ``slice_steps`` must
    be two seasons at least.
    """
    if slice_steps < models.SEASONAL_FROM:
        raise ValueError(f"slice_steps must be {models.SEASONAL_FROM} or more")
    by = [ref(k) for k in keys]
    at = F.floor(F.col("step") / F.lit(slice_steps)).cast("long")
    point = F.struct("step", F.col("value").cast("double").alias("value"))
    sliced = (
        series.select(*by, at.alias("_slice"), point.alias("_point"))
        .groupBy(*by, "_slice")
        .agg(F.transform(F.array_sort(F.collect_list("_point")), lambda p: p["value"]).alias("_values"))
    )
    # A fixed number of partitions: slices are few rows, but each is much work.
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = written(sliced.repartition(parts, *by, "_slice"))
    numbered = written(
        slices.groupBy(*by).agg(F.max("_slice").alias("_last")).withColumn("_series", F.monotonically_increasing_id())
    )
    placed = written(
        join_null_safe(slices, numbered, list(keys))
        .select("_series", "_slice", "_last", "_values")
        .repartition(parts, "_series", "_slice")
    )
    found = _short(placed.where("_last = 0"), periods, weights)
    many = numbered.where("_last > 0")
    if not many.isEmpty():
        found = found.unionByName(_long(placed.where("_last > 0"), many, periods, weights, slice_steps))
    return found.join(numbered, "_series").select(*by, "step", "fitted")


def _small_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` of one row at a time, so that a task holds one slice's work."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame(function(row))

    return df.mapInPandas(rows, schema)


_FITTED = "_series long, step long, fitted double"


def _short(slices: DataFrame, periods: int, weights: Sequence[float] | None) -> DataFrame:
    names = ["series", "values"]
    plain = slices.select(*(F.col(f"_{n}").alias(n) for n in names))

    def fit(row):
        fitted = models.smooth(np.array(row.values, float), periods, weights)
        return {"_series": row.series, "step": np.arange(len(fitted)), "fitted": fitted}

    return _small_batches(plain, fit, _FITTED)


def _shaped(flat, *shape: int) -> np.ndarray:
    return np.array(flat, float).reshape(*shape, -1)


def _starts(slices: DataFrame, last: int, slice_steps: int, sets) -> DataFrame:
    """(series, slice, start): the state before each slice, for each set of weights.

    ``slices``: series, slice, values and centre; ``sets`` gives the weights for a centre.
    """

    def matrix(row):
        y, weights = np.array(row.values, float), sets(np.array(row.centre))
        maps = models.transition(y, SEASON, weights, row.slice * slice_steps)
        start = None
        if row.slice == 0:
            start = np.repeat(models.start_state(y, SEASON)[:, None], weights.shape[1], axis=1).ravel()
        return {"series": [row.series], "slice": [row.slice], "maps": [maps.ravel()], "start": [start]}

    kind = "series long, slice long, maps array<double>, start array<double>"
    levels = [written(_small_batches(slices, matrix, kind))]
    up = F.floor(F.col("slice") / FAN).cast("long")

    def product(children: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("slice")
        maps = None
        for flat in children["maps"]:
            own = _shaped(flat, _STATE, _STATE + 1)
            maps = own if maps is None else models.composed(own, maps)
        head = children.iloc[0]
        return pd.DataFrame(
            {"series": [head["series"]], "slice": [head["slice"] // FAN], "maps": [maps.ravel()], "start": [head["start"]]}
        )

    while last >= FAN:
        last //= FAN
        levels.append(written(levels[-1].groupBy("series", up).applyInPandas(product, kind)))

    def spread(children: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("slice")
        state, found = _shaped(children["start"].iloc[0], _STATE), []
        for flat in children["maps"]:
            found.append(state.ravel())
            state = models.applied(_shaped(flat, _STATE, _STATE + 1), state)
        return pd.DataFrame({"series": children["series"], "slice": children["slice"], "start": found})

    known = levels[-1].where("slice = 0").select("series", F.lit(0).cast("long").alias("parent"), "start")
    for level in reversed(levels):
        children = level.select("series", "slice", "maps", up.alias("parent")).join(known, ["series", "parent"])
        placed = written(
            children.groupBy("series", "parent").applyInPandas(spread, "series long, slice long, start array<double>")
        )
        known = placed.select("series", F.col("slice").alias("parent"), "start")
    return placed


def _long(
    placed: DataFrame, many: DataFrame, periods: int, weights: Sequence[float] | None, slice_steps: int
) -> DataFrame:
    last = many.agg(F.max("_last")).first()[0]
    slices = placed.select(*(F.col(f"_{n}").alias(n) for n in ("series", "slice", "last", "values")))
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.array(*(F.lit(float(x)) for x in weights or models.CENTRE))
    centres = many.select(F.col("_series").alias("series"), first.alias("centre"))

    def with_starts(sets) -> DataFrame:
        """Every slice with its centre and start."""
        known = slices.join(F.broadcast(centres) if centres.count() <= 10_000 else centres, "series")
        starts = _starts(known.select("series", "slice", "values", "centre"), last, slice_steps, sets)
        return known.join(starts, ["series", "slice"]).repartition(parts, "series", "slice")

    width = models.WIDTH
    for _ in range(0 if weights else models.ROUNDS):

        def sets(centre, width=width):
            return models.grid(centre, width, SEASON)

        def errors(row, sets=sets):
            state = _shaped(row.start, _STATE)
            error, *_ = models.run(
                np.array(row.values, float), SEASON, sets(np.array(row.centre)), state, row.slice * slice_steps
            )
            return {"series": [row.series], "errors": [error]}

        sums = (
            _small_batches(with_starts(sets), errors, "series long, errors array<double>")
            .select("series", F.posexplode("errors").alias("set", "error"))
            .groupBy("series", "set")
            .agg(F.sum("error").alias("error"))
            .groupBy("series")
            .agg(F.min(F.struct("error", "set"))["set"].alias("set"))
        )

        def moved(row, sets=sets):
            return {"series": [row.series], "centre": [sets(np.array(row.centre))[:, row.set]]}

        centres = written(_small_batches(centres.join(sums, "series"), moved, "series long, centre array<double>"))
        width /= models.SHRINK

    def one(centre):
        return centre.reshape(3, 1)

    def fit(row):
        y, at = np.array(row.values, float), row.slice * slice_steps
        _, fitted, state = models.run(y, SEASON, one(np.array(row.centre)), _shaped(row.start, _STATE), at)
        if row.slice == row.last:
            fitted = np.concatenate([fitted, models.ahead(state[:, 0], at + len(y), periods)])
        return {"_series": row.series, "step": at + np.arange(len(fitted)), "fitted": fitted}

    return _small_batches(with_starts(one), fit, _FITTED)
