"""k-means whose starts all advance in the same scans of the table.

A scan compares every row with the centres of all starts and returns counts,
sums and costs by (start, cluster), combined on the map side; so an iteration
of ten starts reads the table once. Starts that have come to rest leave the
scan. First centres are drawn in rounds: each round takes, for every start, the
rows that win a race with odds proportional to their squared distance from the
centres drawn before, which needs one scan and returns a fixed number of rows.
The rows drawn are weighted by the rows nearest to them and reduced to ``k``.

Nothing is cached: the table should be stored in columns (see ``durable``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.coerce import ref

ROUNDS = 2
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
#: Distances that a task holds at once.
CELLS = 2_000_000


@dataclass(frozen=True)
class Fit:
    """``centres`` has a row per cluster; ``cost`` is the sum of squared distances."""

    centres: np.ndarray
    cost: float
    iterations: int


def squared_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    cross = rows @ centres.T
    return np.maximum((rows * rows).sum(1)[:, None] - 2 * cross + (centres * centres).sum(1), 0.0)


def _blocks(batches: Iterator[pa.RecordBatch], centres: int) -> Iterator[np.ndarray]:
    """Rows of features, in blocks of which ``CELLS`` bounds the distances."""
    size = max(1, CELLS // max(centres, 1))
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("f8")
        for at in range(0, len(rows), size):
            yield rows[at : at + size]


def _totals(points: DataFrame, starts: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per start: rows and sums of its clusters, and its cost. One scan for all starts."""
    width = len(points.columns)
    every = np.concatenate(starts)
    edges = np.cumsum([0, *map(len, starts)])

    def work(batches):
        n, sums, cost = np.zeros(len(every)), np.zeros((len(every), width)), np.zeros(len(every))
        for rows in _blocks(batches, len(every)):
            far = squared_distances(rows, every)
            for a, b in zip(edges[:-1], edges[1:]):
                own = a + far[:, a:b].argmin(1)
                n += np.bincount(own, minlength=len(every))
                gap = ((rows - every[own]) ** 2).sum(1)
                cost += np.bincount(own, gap, minlength=len(every))
                for j in range(width):
                    sums[:, j] += np.bincount(own, rows[:, j], minlength=len(every))
        used = np.flatnonzero(n)
        columns = [used.astype("i4"), n[used].astype("i8"), cost[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["centre", "n", "cost", *(f"s{j}" for j in range(width))]
    schema = "centre int, n long, cost double" + "".join(f", s{j} double" for j in range(width))
    parts = points.mapInArrow(work, schema)
    # At most a row per centre comes back.
    found = parts.groupBy("centre").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()
    n, sums, cost = np.zeros(len(every)), np.zeros((len(every), width)), np.zeros(len(every))
    for row in found:
        n[row["centre"]], cost[row["centre"]] = row["n"], row["cost"]
        sums[row["centre"]] = row[3:]
    return [(n[a:b], sums[a:b], float(cost[a:b].sum())) for a, b in zip(edges[:-1], edges[1:])]


def _drawn(points: DataFrame, chosen: Sequence[np.ndarray], take: int, seed: Sequence[int]) -> list[np.ndarray]:
    """Per start, ``take`` rows won by a race with odds by squared distance; even odds without centres."""
    width = len(points.columns)
    total = sum(map(len, chosen))

    def work(batches):
        # Seeded by partition, so a task that is run again draws the same rows.
        rng = np.random.default_rng([*seed, TaskContext.get().partitionId()])
        best = [(np.empty(0), np.empty((0, width))) for _ in chosen]
        for rows in _blocks(batches, total):
            for i, centres in enumerate(chosen):
                time = rng.exponential(size=len(rows))
                if len(centres):
                    near = centres[squared_distances(rows, centres).argmin(1)]
                    odds = ((rows - near) ** 2).sum(1)
                    time = np.divide(time, odds, out=np.full(len(rows), np.inf), where=odds > 0)
                running = np.flatnonzero(np.isfinite(time))
                times = np.concatenate([best[i][0], time[running]])
                first = np.argsort(times, kind="stable")[:take]
                best[i] = times[first], np.concatenate([best[i][1], rows[running]])[first]
        owner = np.repeat(np.arange(len(chosen), dtype="i4"), [len(t) for t, _ in best])
        columns = [owner, np.concatenate([t for t, _ in best]), *np.concatenate([r for _, r in best]).T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["start", "time", *(f"x{j}" for j in range(width))]
    schema = "start int, time double" + "".join(f", x{j} double" for j in range(width))
    place = F.row_number().over(Window.partitionBy("start").orderBy("time", *names[2:]))
    won = points.mapInArrow(work, schema).withColumn("place", place).where(F.col("place") <= take)
    found = [[] for _ in chosen]
    for row in won.collect():
        found[row["start"]].append(row[2:-1])
    return [np.array(rows, "f8").reshape(-1, width) for rows in found]


def _reduced(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of a few weighted rows."""
    if len(rows) <= k:
        return rows
    weights = np.maximum(weights, 1e-9)
    centres = rows[[rng.choice(len(rows), p=weights / weights.sum())]]
    while len(centres) < k:
        odds = squared_distances(rows, centres).min(1) * weights
        odds[(rows[:, None] == centres[None]).all(2).any(1)] = 0
        if not odds.sum():
            break
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=odds / odds.sum())]])
    for _ in range(30):
        own = squared_distances(rows, centres).argmin(1)
        moved = np.array(
            [
                np.average(rows[own == c], axis=0, weights=weights[own == c]) if (own == c).any() else centres[c]
                for c in range(len(centres))
            ]
        )
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def first_centres(points: DataFrame, k: int, starts: int, seed: int) -> list[np.ndarray]:
    """``k`` centres for each start; fewer where the table has fewer different rows."""
    chosen = [np.empty((0, len(points.columns)))] * starts
    new = _drawn(points, chosen, 1, (seed, 0))
    done = 0
    while any(map(len, new)):
        chosen = [np.unique(np.concatenate([a, b]), axis=0) for a, b in zip(chosen, new)]
        if done >= ROUNDS and min(map(len, chosen)) >= k:
            break
        done += 1
        new = _drawn(points, chosen, 2 * k, (seed, done))
    if not len(chosen[0]):
        return chosen
    rng = np.random.default_rng(seed)
    return [_reduced(rows, n, k, rng) for rows, (n, _, _) in zip(chosen, _totals(points, chosen))]


def refine(
    points: DataFrame,
    starts: Sequence[np.ndarray],
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> list[Fit]:
    """Lloyd's iterations from given centres, a scan for all starts that still move.

    A start rests when the squared moves of its centres sum to ``tolerance`` at
    most, in units of the features' variance if they are standardised. A centre
    without rows stays where it is.
    """
    fits = [Fit(np.asarray(c, "f8"), np.inf, 0) for c in starts]
    moving = [i for i, f in enumerate(fits) if len(f.centres)]
    for turn in range(1, max_iterations + 1):
        if not moving:
            break
        still = []
        for i, (n, sums, cost) in zip(moving, _totals(points, [fits[i].centres for i in moving])):
            old = fits[i].centres
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old)
            fits[i] = Fit(new, cost, turn)
            if ((new - old) ** 2).sum() > tolerance:
                still.append(i)
        moving = still
    return fits


def fit_kmeans(points: DataFrame, k: int, starts: int, seed: int) -> Fit:
    """The start of lowest cost. ``points`` has the features alone, as doubles without NULLs."""
    if k < 1 or starts < 1:
        raise ValueError("k and starts must be positive")
    return min(refine(points, first_centres(points, k, starts, seed)), key=lambda f: f.cost)


def assign(df: DataFrame, names: Sequence[str], centres: np.ndarray, cluster: str = "cluster") -> DataFrame:
    """``df`` with the number of each row's nearest centre."""

    @F.pandas_udf("int")
    def nearest(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy("f8") for c in columns])
        size = max(1, CELLS // len(centres))
        parts = [squared_distances(rows[a : a + size], centres).argmin(1) for a in range(0, len(rows), size)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0, "i4"))

    return df.withColumn(cluster, nearest(*[ref(n).cast("double") for n in names]))
