import numpy as np
import pandas as pd

from tablewright.ml import supervised
from tablewright.ml.features import MAX_BINS, bin_borders


def test_boosted_trees_read_points_and_not_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 6000
    x, y, kind = rng.normal(size=n), rng.exponential(size=n), rng.integers(0, 3, n)
    table = pd.DataFrame({"x": x, "y": y, "kind": kind, "answer": np.where((x > 0.1) ^ (kind == 2), "yes", "no")})
    seen = []
    plain = supervised.weighted_points

    def kept(rows, names):
        found = plain(rows, names)
        seen.append((rows.count(), found.count(), found.agg({"weight": "sum"}).first()[0]))
        return found

    monkeypatch.setattr(supervised, "weighted_points", kept)
    found = supervised.run_classification(
        spark.createDataFrame(table), "answer", ["x", "kind"], "boosted_trees", cross_validate=False
    )
    rows, points, weight = seen[0]
    assert weight == rows and 4790 <= rows <= 4800 and points <= MAX_BINS * 3 * 2
    assert found.best_score > 0.95
    assert [r["feature"] for r in found.importances.collect()] != []


def test_borders(spark):
    table = spark.createDataFrame(
        [(float(i % 4) ** 2, float(i), 5.0) for i in range(1000)], "few double, many double, same double"
    )
    found = bin_borders(table, ["few", "many", "same"])
    assert found["few"] == [0.5, 2.5, 6.5] and found["same"] == []
    assert len(found["many"]) == MAX_BINS - 1
    counts = np.histogram(np.arange(1000.0), [-1, *found["many"], 1000])[0]
    assert counts.min() >= 31 and counts.max() <= 32
