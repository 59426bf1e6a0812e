"""Correlations from Gram matrices."""

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import gram, stats


def test_many_columns_equal_the_pairwise_ones(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(1)
    table = pd.DataFrame(rng.normal(size=(700, 120)) + 1e6, columns=[f"c {i}" for i in range(120)])
    table["c 1"] += 3 * table["c 0"]
    table["c 2"] = 0.1
    table[rng.random(table.shape) < 0.2] = np.nan
    table["c 3"] = np.nan
    df = spark.createDataFrame(table).repartition(6)
    found = {(r.column_a, r.column_b): r.r for r in stats.correlations(df, list(table)).collect()}
    assert len(found) == 120 * 119 // 2
    expected = table.drop(columns=["c 2", "c 3"]).corr()
    for (a, b), r in found.items():
        if {a, b} & {"c 2", "c 3"}:
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_merging_equals_one_block():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[:30, 4] = np.nan
    parts = [gram.moments(x[a:b]) for a, b in ((0, 30), (30, 31), (31, 90))]
    found = gram.merged(gram.merged(parts[0], parts[1]), parts[2])
    assert found == pytest.approx(gram.moments(x), abs=1e-9)


def test_no_rows(spark):
    df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(20)))
    assert {r.r for r in stats.correlations(df, df.columns).collect()} == {None}
