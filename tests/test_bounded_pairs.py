import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.ml.density import _near_cells, dbscan
from tests.test_models import _reference_clusters


@pytest.mark.parametrize("dims, eps", [(4, 0.5), (5, 0.8)])
def test_many_features_equal_brute_force(spark, dims, eps):
    rng = np.random.default_rng(5)
    names = [f"x{i}" for i in range(dims)]
    steps = np.arange(40)[:, None] * np.eye(dims)[-1] * eps * 0.24  # a thin chain along the last feature
    points = np.concatenate(
        [
            rng.normal(-3, 0.2, (80, dims)),
            rng.normal(3, 0.5, (80, dims)),
            rng.uniform(-4, 4, (60, dims)),
            np.full(dims, 1.0) * eps + steps - 8,
            np.zeros((10, dims)),
        ]
    )
    labels, core = _reference_clusters(points, eps, 5)
    assert 0 < core.sum() < len(core) and len(set(labels[core])) > 3
    df = spark.createDataFrame(pd.DataFrame(points, columns=names))
    got = dbscan(df, names, eps, 5).toPandas()
    expected = pd.DataFrame(points, columns=names).assign(label=labels, core=core)
    both = got.drop_duplicates(names).merge(expected.drop_duplicates(names), on=names)
    assert len(got) == len(points) and len(both) == len(expected.drop_duplicates(names))
    assert ((both.cluster < 0) == (both.label < 0)).all()
    cores = both[both.core]
    assert cores.groupby("label").cluster.nunique().max() == 1
    assert cores.groupby("cluster").label.nunique().max() == 1


def test_only_cells_in_reach_are_paired(spark):
    """Cells far apart in the last features alone, which shared a zone of the first three, form no pair."""
    rng = np.random.default_rng(6)
    cells = sorted({tuple(int(x) for x in c) for c in rng.integers(-5, 6, (300, 5))})
    table = spark.createDataFrame([(list(c),) for c in cells], "cell array<bigint>")
    near = lambda a, b: sum(max(abs(i - j) - 1, 0) ** 2 for i, j in zip(a, b)) <= 5
    got = {(tuple(r["a"]), tuple(r["b"])) for r in _near_cells(table, table, 5, 3).collect()}
    assert got == {(a, b) for a in cells for b in cells if near(a, b)}
    rooted = table.withColumn("root", F.when(F.col("cell")[4] < 3, F.array(F.lit(-9).cast("long"))).otherwise(F.col("cell")))
    root = lambda c: (-9,) if c[4] < 3 else c
    got = [(tuple(r["a"]), tuple(r["b"])) for r in _near_cells(rooted, rooted, 5, 3, apart=True).collect()]
    expected = {(a, b) for a in cells for b in cells if a < b and near(a, b) and root(a) != root(b)}
    assert len(got) == len(set(got)) and set(got) == expected
