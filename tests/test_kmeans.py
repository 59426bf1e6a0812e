import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from tablewright.ml import kmeans
from tablewright.ml.cluster import run_clustering


def plain_lloyd(rows, centres, turns, tolerance=kmeans.TOLERANCE):
    """One start, one distance at a time."""
    for turn in range(1, turns + 1):
        own = [min(range(len(centres)), key=lambda c: float(((r - centres[c]) ** 2).sum())) for r in rows]
        cost = sum(float(((r - centres[c]) ** 2).sum()) for r, c in zip(rows, own))
        new = np.array(
            [rows[[o == c for o in own]].mean(0) if c in own else centres[c] for c in range(len(centres))]
        )
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= tolerance:
            break
    return centres, cost, turn


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 3)) * 4
    rows = middle[rng.integers(0, 6, 400)] + rng.normal(size=(400, 3))
    return rows, spark.createDataFrame(pd.DataFrame(rows, columns=list("xyz"))).repartition(5)


@pytest.mark.parametrize("cells", [7, kmeans.CELLS])
def test_starts_advance_together_as_they_would_alone(cloud, monkeypatch, cells):
    rows, points = cloud
    starts = [rows[:4], rows[10:16], np.vstack([rows[:2], [[900.0, 900.0, 900.0]]])]
    scans, scan = [], kmeans._totals
    monkeypatch.setattr(kmeans, "CELLS", cells)
    monkeypatch.setattr(kmeans, "_totals", lambda p, s: scans.append(len(s)) or scan(p, s))
    for fit, start in zip(kmeans.refine(points, starts, 12), starts):
        centres, cost, turns = plain_lloyd(rows, start, 12)
        np.testing.assert_allclose(fit.centres, centres, rtol=1e-9)
        assert fit.cost == pytest.approx(cost) and fit.iterations == turns
    assert len(scans) <= 12 and scans[0] == 3


def test_cost_is_no_worse_than_ten_separate_fits(cloud):
    rows, points = cloud
    fit = kmeans.fit_kmeans(points, 6, 10, 42)
    table = VectorAssembler(inputCols=list("xyz"), outputCol="features").transform(points)
    other = min(KMeans(k=6, seed=s).fit(table).summary.trainingCost for s in range(3))
    assert fit.cost <= other * 1.01 and fit.centres.shape == (6, 3)


def test_the_same_rows_give_the_same_centres(cloud):
    first, again = (kmeans.fit_kmeans(cloud[1], 5, 3, 1) for _ in range(2))
    np.testing.assert_allclose(first.centres, again.centres)


def test_few_different_rows_and_a_hot_one(spark):
    """All different rows are found beside a row that is repeated 5,000 times."""
    rows = [(0.0, 0.0)] * 5000 + [(float(i), 1.0) for i in range(1, 6)]
    points = spark.createDataFrame(rows, "x double, y double").repartition(4)
    fit = kmeans.fit_kmeans(points, 6, 2, 3)
    assert fit.cost == pytest.approx(0.0, abs=1e-9) and len(fit.centres) == 6
    assert len(kmeans.fit_kmeans(points, 9, 2, 3).centres) == 6
    assert sorted(r["rows"] for r in run_clustering(points, ["x", "y"], n_clusters=9).sizes.collect()) == [1] * 5 + [5000]


def test_empty_table_and_bad_numbers(spark):
    points = spark.createDataFrame([], "x double")
    assert len(kmeans.fit_kmeans(points, 2, 2, 1).centres) == 0
    with pytest.raises(ValueError, match="positive"):
        kmeans.fit_kmeans(points, 0, 2, 1)
