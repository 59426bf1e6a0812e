import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.forecast.models import smooth
from tablewright.forecast.prepare import interpolate, prepare
from tablewright.forecast.report import run_forecast
from tablewright.ml.cluster import run_clustering
from tablewright.ml.density import dbscan
from tablewright.ml.features import encode_features, recommended_tasks, screen_features
from tablewright.ml.supervised import explain_model, run_classification, run_regression
from tablewright.operators.profile import profile


@pytest.fixture(scope="module")
def linear(spark):
    return spark.range(1, 101).select(F.col("id").alias("x"), (F.col("id") * 2 + 5).alias("y"))


@pytest.fixture(scope="module")
def two_class(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-3, 0.4, (60, 2)), rng.normal(3, 0.4, (60, 2))])
    return spark.createDataFrame(
        [(float(a), float(b), "low" if i < 60 else "high") for i, (a, b) in enumerate(x)],
        "x1 double, x2 double, target string",
    )


def test_linear_regression(linear):
    found = run_regression(linear, "y", ["x", "y"], "linear_regression")
    row = found.scores.first()
    assert row["r2_score"] > 0.99 and row["mae"] < 0.01 and row["cv_folds"] == 5
    assert found.features == ["x"] and "leak" in found.warnings[0]
    assert found.explanation == "exact_linear"
    shown = found.actual_vs_predicted.collect()
    assert len(shown) == 20 and shown[0]["actual"] == pytest.approx(shown[0]["predicted"])
    best = found.scored.select("contributions").first()[0][0]
    assert best["feature"] == "x"


def test_classification(two_class):
    found = run_classification(two_class, "target", ["x1", "x2"], "logistic_regression")
    row = found.scores.first()
    assert row["accuracy"] > 0.95 and row["f1_score"] > 0.95 and row["cv_accuracy_mean"] > 0.95
    assert found.classes == ["high", "low"]
    assert found.confusion.agg(F.sum("`0.0`") + F.sum("`1.0`")).first()[0] == 24


def test_three_models(two_class):
    found = run_classification(two_class, "target", ["x1", "x2"], cross_validate=False)
    names = [r["model"] for r in found.scores.collect()]
    assert sorted(names) == ["decision_tree", "logistic_regression", "random_forest"]
    assert found.best_model == "logistic_regression"


def test_screening(spark):
    df = spark.range(60).select(
        F.col("id").cast("double").alias("signal"),
        F.lit("same").alias("constant_col"),
        F.concat(F.lit("id_"), "id").alias("id_col"),
        F.when(F.col("id") < 30, "a").otherwise("b").alias("target"),
    )
    kept, warnings = screen_features(
        df, "target", ["signal", "constant_col", "id_col", "absent", "target"], 60
    )
    assert kept == ["signal"] and len(warnings) == 4
    with pytest.raises(ValueError, match="No usable"):
        screen_features(df, "target", ["constant_col"], 60)


def test_training_rejects(two_class, spark):
    with pytest.raises(ValueError, match="at least 10"):
        run_classification(two_class.limit(5), "target", ["x1"])
    with pytest.raises(ValueError, match="distinct class"):
        run_classification(two_class.where("target = 'low'"), "target", ["x1"])
    with pytest.raises(ValueError, match="not found"):
        run_regression(two_class, "nope", ["x1"])
    with pytest.raises(ValueError, match="constant"):
        run_regression(two_class.withColumn("c", F.lit(1)), "c", ["x1"])
    with pytest.raises(ValueError, match="feature"):
        run_regression(two_class, "x1", [])


def test_encoding(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 5.0)], "k string, v double")
    rows = encode_features(df, ["k", "v"])[0].collect()
    assert [(r["f0"], r["f1"]) for r in rows] == [(2.0, 1.0), (1.0, 3.0), (0.0, 5.0)]


def test_recommended_tasks(sales):
    assert recommended_tasks(profile(sales)) == ["forecasting", "classification"]


def test_kmeans_blobs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-5, 0.3, (50, 2)), rng.normal(5, 0.3, (50, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"]))
    found = run_clustering(df, ["x", "y"], n_clusters=2, restarts=2)
    assert found.clusters_found == 2 and found.silhouette > 0.8
    assert sorted(r["rows"] for r in found.sizes.collect()) == [50, 50]
    assert found.points.count() == 100


def _reference_clusters(points, eps, min_points):
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_points
    labels = -np.ones(len(points), int)
    for start in np.flatnonzero(core):
        if labels[start] < 0:
            labels[start], stack = start, [start]
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if labels[j] < 0:
                        labels[j] = start
                        if core[j]:
                            stack.append(j)
    return labels, core


@pytest.mark.parametrize("dims, eps", [(2, 0.3), (3, 0.7)])
def test_dbscan_equals_brute_force(spark, dims, eps):
    rng = np.random.default_rng(3)
    names = ["x", "y", "z"][:dims]
    points = np.concatenate(
        [
            rng.normal(-2, 0.25, (120, dims)),
            rng.normal(1, 0.4, (120, dims)),
            rng.uniform(-4, 4, (50, dims)),
            np.zeros((100, dims)),
        ]
    )
    labels, core = _reference_clusters(points, eps, 5)
    df = spark.createDataFrame(pd.DataFrame(points, columns=names))
    got = dbscan(df, names, eps, 5).toPandas()
    assert len(got) == len(points)
    expected = pd.DataFrame(points, columns=names).assign(label=labels, core=core)
    both = got.drop_duplicates(names).merge(expected.drop_duplicates(names), on=names)
    assert ((both.cluster < 0) == (both.label < 0)).all()
    cores = both[both.core]
    assert cores.groupby("label").cluster.nunique().max() == 1
    assert cores.groupby("cluster").label.nunique().max() == 1
    with pytest.raises(ValueError):
        dbscan(df, ["x"] * 4, eps, 5)


def _daily(spark, values, start=dt.datetime(2026, 1, 1)):
    return spark.createDataFrame(
        [(start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
        "date timestamp_ntz, sales double",
    )


def test_forecast_upward(spark):
    found = run_forecast(_daily(spark, range(100, 160)), "date", "sales", 10)
    rows = sorted(found.forecast.collect(), key=lambda r: r["horizon"])
    assert len(rows) == 10 and rows[-1]["value"] == pytest.approx(169, abs=0.5)
    assert rows[0]["ts"] == dt.datetime(2026, 3, 2)
    assert found.summary.first()["trend_direction"] == "upward"
    assert found.evaluation.first()["available"]
    assert found.history.count() == 60


def test_interval_widens(spark):
    noise = np.random.default_rng(4).normal(0, 5, 60)
    found = run_forecast(_daily(spark, np.arange(60) + noise), "date", "sales", 10)
    rows = sorted(found.forecast.collect(), key=lambda r: r["horizon"])
    widths = [r["upper"] - r["lower"] for r in rows]
    assert widths == sorted(widths) and widths[0] < widths[-1]


def test_zero_holdout_has_no_mape(spark):
    row = run_forecast(_daily(spark, [5] * 50 + [0] * 10), "date", "sales", 3).evaluation.first()
    assert row["available"] and row["mape"] is None and row["mae"] is not None


def test_duplicates_and_gaps(spark):
    df = _daily(spark, range(20)).where("sales <> 7")
    twice = df.unionByName(df.where("sales = 3").withColumn("sales", F.lit(5.0)))
    found = run_forecast(twice, "date", "sales", 2)
    row = found.summary.first()
    assert (row["duplicate_rows"], row["filled_steps"]) == (1, 1)
    values = [r["value"] for r in sorted(found.history.collect(), key=lambda r: r["ts"])]
    assert values[3] == 4.0 and values[7] == 7.0


def test_month_calendar(spark):
    months = [dt.datetime(2024 + i // 12, i % 12 + 1, 1) for i in range(24)]
    df = spark.createDataFrame([(m, float(i)) for i, m in enumerate(months)], "d timestamp_ntz, v double")
    info = prepare(df, "d", "v").info.first()
    assert (info["unit"], info["stride"], info["steps"]) == ("month", 1, 24)
    last = run_forecast(df, "d", "v", 2).forecast.orderBy("horizon").collect()[-1]
    assert last["ts"] == dt.datetime(2026, 2, 1)


def test_hour_grain(spark):
    df = spark.range(48).select(
        F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, id, 0, 0)").alias("d"),
        F.col("id").cast("double").alias("v"),
    )
    last = run_forecast(df, "d", "v", 3, grain="hour").forecast.orderBy("horizon").collect()[-1]
    assert last["ts"] == dt.datetime(2026, 1, 3, 2) and last["value"] == pytest.approx(50, abs=0.5)


def test_many_series(spark):
    df = _daily(spark, range(30)).crossJoin(spark.createDataFrame([("a",), (None,)], "k string"))
    short = _daily(spark, [1, 2]).withColumn("k", F.lit("short"))
    found = run_forecast(df.unionByName(short), "date", "sales", 4, ["k"])
    assert found.forecast.count() == 8
    assert {r["k"]: r["available"] for r in found.summary.collect()} == {
        "a": True,
        None: True,
        "short": False,
    }


def test_forecast_rejects(spark):
    df = _daily(spark, range(30))
    for bad in (0, 731, None):
        with pytest.raises(ValueError, match="periods"):
            run_forecast(df, "date", "sales", bad)
    with pytest.raises(ValueError, match="observation"):
        run_forecast(df.limit(3), "date", "sales")
    with pytest.raises(ValueError, match="date/time"):
        run_forecast(df.withColumn("date", F.lit("x")), "date", "sales")
    with pytest.raises(ValueError, match="numeric"):
        run_forecast(df.withColumn("sales", F.lit("x")), "date", "sales")


def test_interpolation_ends(spark):
    df = spark.createDataFrame(
        [(0, None), (1, 10.0), (2, None), (3, None), (4, 40.0), (5, None)], "i int, v double"
    )
    rows = sorted(interpolate(df, "v", "i", []).collect())
    assert [r["v"] for r in rows] == [10, 10, 20, 30, 40, 40]


def test_smoothing_finds_the_season():
    t = np.arange(70)
    y = 50 + 0.5 * t + 8 * np.sin(2 * np.pi * t / 7)
    assert smooth(y[:60], 10)[60:] == pytest.approx(y[60:], abs=0.5)


def test_explain_model(two_class):
    importances, scored = explain_model(two_class, "target", ["x1", "x2"], algorithm="decision_tree")
    assert importances.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert scored.count() == 24 and len(scored.first()["contributions"]) == 2
    with pytest.raises(ValueError, match="Unknown task"):
        explain_model(two_class, "target", ["x1"], "clustering")
