import struct

import pytest

from tablewright.operators import quantiles, query as ask
from tablewright.operators.ordering import forward_fill, with_row_number
from tablewright.operators.quantiles import column_quantiles, group_quantiles
from tablewright.plans.registry import run_operator
from pyspark.sql import functions as F

by = pytest.by


def test_aggregate(sales):
    row = ask.aggregate(sales, "sales").first()
    assert (row["value"], row["valid_rows"], row["excluded_rows"]) == (1000, 4, 0)
    assert ask.aggregate(sales, "sales", "mean").first()["value"] == 250
    assert ask.aggregate(sales, "sales", "median").first()["value"] == 250


def test_aggregate_rejects(sales):
    with pytest.raises(ValueError):
        ask.aggregate(sales, "sales", "mode")
    with pytest.raises(Exception, match="no numbers in"):
        ask.aggregate(sales, "region").collect()
    with pytest.raises(ValueError):
        ask.group_by(sales, "region", "product")
    with pytest.raises(ValueError):
        ask.group_by(sales, "sales", "region", limit=0)


def test_group_by(sales):
    assert by(ask.group_by(sales, "sales", "region"), "dimension_value", "value") == {
        "North": 400,
        "South": 600,
    }


def test_null_group_stays_apart_from_its_label(spark):
    df = spark.createDataFrame(
        [(None, 5), ("Missing", 3), (None, 1)], "region string, sales long"
    )
    rows = [tuple(r) for r in ask.group_by(df, "sales", "region").collect()]
    assert rows == [("Missing", 6.0), ("Missing", 3.0)]


def test_trend(sales):
    rows = [tuple(r) for r in ask.trend(sales, "date", "sales", "M").collect()]
    assert rows == [("2026-01", 300.0), ("2026-02", 700.0)]


def test_filled_trend(make_dated):
    df = make_dated([("2026-01-05", 10), ("2026-04-05", 20)])
    rows = [tuple(r) for r in ask.filled_trend(df, "date", "sales").collect()]
    assert rows == [("2026-01", 10.0), ("2026-02", 0.0), ("2026-03", 0.0), ("2026-04", 20.0)]


def test_run_operator(sales):
    found = run_operator(sales, "aggregate", {"metric_column": "sales"})
    assert found.first()["value"] == 1000
    with pytest.raises(ValueError, match="Unknown operator"):
        run_operator(sales, "drop_table")


@pytest.fixture(scope="module")
def heavy(spark):
    """One value holds a third of the rows, one group a third of the table."""
    return spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias(
            "k"
        ),
        F.when(F.col("id") % 3 == 1, 7.0).otherwise(F.pmod(F.hash("id"), F.lit(10007)) / 3.0).alias("x"),
    )


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_selected_column_quantiles_are_exact(heavy):
    expected = heavy.select(F.percentile("x", F.array(*[F.lit(p) for p in PROBS]))).first()[0]
    assert column_quantiles(heavy, ["x"], PROBS, in_memory_rows=50)["x"] == pytest.approx(expected)


@pytest.mark.parametrize("leaf_rows, broadcast_groups", [(5000, 100), (200, 100), (0, 100), (200, 2)])
def test_selected_group_quantiles_are_exact(heavy, monkeypatch, leaf_rows, broadcast_groups):
    monkeypatch.setattr(quantiles, "HOT_GROUPS", 5)
    expected = {r["k"]: tuple(r)[1:] for r in group_quantiles(heavy, ["k"], "x", PROBS).collect()}
    found = group_quantiles(heavy, ["k"], "x", PROBS, leaf_rows, broadcast_groups)
    got = {r["k"]: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(expected[k])


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
ODD += [x for e in (-1070, -1022, -7, 0, 1, 52, 53, 1000) for x in (2.0**e, -(2.0**e), 2.0**e * (1 - 2**-53), 1.1 * 2.0**e)]
ODD += [float("inf"), float("-inf"), 0.1, 1 / 3, -123456.789]


def test_bits_order_as_values_do(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x double")
    for r in quantiles.ordered_bits(rows, "x", "bits").collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["bits"] == (-bits if r["x"] < 0 else bits), r["x"]


def test_quantiles_of_far_apart_values(spark):
    finite = sorted(x for x in ODD if abs(x) < 1e300)
    rows = [(None, x) for x in finite * 3] + [("a", 7.0)] * 40 + [("b", 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    found = {r["k"]: r for r in group_quantiles(df, ["k"], "x", [0.0, 0.5, 1.0], in_memory_rows=1).collect()}
    assert set(found) == {None, "a", "b"}
    whole = sorted(finite * 3)
    middle = (whole[(len(whole) - 1) // 2] + whole[len(whole) // 2]) / 2
    assert (found[None]["q0"], found[None]["q1"], found[None]["q2"]) == (whole[0], middle, whole[-1])
    assert found["a"]["q1"] == 7.0 and found["a"]["rows"] == 40 and found["b"]["q2"] == 2.0


def test_quantiles_without_numbers(spark):
    df = spark.createDataFrame([(None, "a")], "x double, y string")
    assert column_quantiles(df, ["x", "y"], [0.5], in_memory_rows=0) == {"x": None, "y": None}


def test_row_numbers_with_copies(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", 2)] * 3 + [(None, 3)] * 2, "k string, v int")
    ranked = with_row_number(df, [F.col("v")], ["k"], slices=4).collect()
    for key, n in (("a", 500), ("b", 3), (None, 2)):
        ranks = sorted(r["rank"] for r in ranked if r["k"] == key)
        assert ranks == list(range(1, n + 1))
        assert {r["rank_total"] for r in ranked if r["k"] == key} == {n}


def test_forward_fill_matches_a_loop(spark):
    rows = [(i, i % 3, None if i % 4 else i * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, k int, v int")
    filled = {r["i"]: r["v"] for r in forward_fill(df, ["v"], ["i"], ["k"], slices=5).collect()}
    last, expected = {}, {}
    for i, k, v in rows:
        last[k] = v if v is not None else last.get(k)
        expected[i] = last[k]
    assert filled == expected


def test_quantiles_of_whole_columns_with_hard_values(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    hard = [5e-324, 1e-323, -5e-324, -0.0, 0.0, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52]
    wide = np.concatenate([rng.normal(size=800) * 10.0 ** rng.integers(-300, 300, 800), hard * 20])
    near = np.concatenate([1.0 + rng.integers(0, 50, 1000) * 2.0**-52, np.full(20, -3.0)])
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(wide, near)], "wide double, near double")
    shares = [i / 64 for i in range(65)]
    ranks = [p * 1019 for p in shares]
    found = quantiles.column_quantiles(table, ["wide", "near"], shares, in_memory_rows=4)
    for name, values in (("wide", np.sort(wide)), ("near", np.sort(near))):
        assert len(values) == 1020
        for rank, got in zip(ranks, found[name]):
            low, high = values[int(np.floor(rank))], values[int(np.ceil(rank))]
            expected = low if low == high else low + (rank - np.floor(rank)) * (high - low)
            assert got == expected or np.isnan(got) and np.isnan(expected)


def test_passes_over_whole_columns_read_plain_values(spark, monkeypatch):
    """No row of a whole column is turned into bits one by one."""

    def refused(*_):
        raise AssertionError

    monkeypatch.setattr(quantiles, "ordered_bits", refused)
    table = spark.range(2000).selectExpr("CAST(id AS DOUBLE) AS x")
    assert quantiles.column_quantiles(table, ["x"], [0.5], in_memory_rows=10) == {"x": [999.5]}
