import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, clean, profile, stats
from tablewright.sources import jdbc, nested, reports, tables

by = pytest.by


def test_duplicates(spark):
    df = spark.createDataFrame(
        [("A", 100), ("A", 100), ("B", 200), ("C", 300)], "product string, sales long"
    )
    found = profile.profile(df)
    assert (found.row_count, found.duplicate_count) == (4, 1)
    nulls = spark.createDataFrame([(None, None)] * 3 + [("a", None)], "x string, y int")
    assert profile.duplicate_count(nulls).first()["duplicate_rows"] == 2


def test_missing(spark):
    df = spark.createDataFrame(
        [(100.0, 1), (None, 2), (float("nan"), 3), (None, 4)], "sales double, quantity long"
    )
    found = profile.profile(df)
    assert found.missing_cells == 3
    two = profile.profile(df.where("quantity <> 3").unionByName(df.where("quantity = 1")))
    assert (two.missing_cells, two.missing_pct) == (2, 25.0)


def test_summary(sales):
    row = profile.dataset_summary(sales).first()
    assert (row["row_count"], row["column_count"]) == (4, 4)
    assert (row["duplicate_rows"], row["missing_cells"]) == (0, 0)
    assert row["missing_by_column"] == {}
    with pytest.raises(ValueError, match="empty"):
        profile.dataset_summary(sales.limit(0))


def test_semantic_types(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("code"),
        F.col("id").alias("number"),
        (F.col("id") % 3).cast("double").alias("ratio"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.date_format(F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("id") % 90).cast("int")), "M/d/yyyy").alias("day"),
        F.concat(F.lit("name "), F.col("id")).alias("name"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"),
        F.repeat(F.lit("long text "), 10).alias("essay"),
    )
    found = {c.name: c.inferred_type for c in profile.profile(df).columns}
    assert found == {
        "code": "categorical",
        "number": "numerical",
        "ratio": "numerical",
        "flag": "boolean",
        "day": "datetime",
        "name": "text",
        "kind": "categorical",
        "essay": "text",
    }


def test_dedupe_and_median(spark):
    df = spark.createDataFrame(
        [("A", 100), ("A", 100), ("B", 200)], "product string, sales long"
    )
    done = clean.clean(df)
    assert (done.rows_before, done.rows_after, done.df.count()) == (3, 2, 2)
    gaps = spark.createDataFrame([(100.0,), (200.0,), (None,), (300.0,), (400.0,)], "sales double")
    filled = clean.clean(gaps, False).df
    assert sorted(r[0] for r in filled.collect()) == [100, 200, 250, 300, 400]


def test_mode_and_unknown(spark):
    df = spark.createDataFrame(
        [("b", None), ("a", None), (None, None)], "x string, y string"
    )
    rows = clean.clean(df, False, "mode").df.collect()
    assert [r["x"] for r in rows] == ["b", "a", "a"]
    assert {r["y"] for r in rows} == {"Unknown"}


def test_forward_fill_needs_an_order(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2026, 1, 1)), (2, None), (3, dt.date(2026, 1, 3))], "i int, d date"
    )
    with pytest.raises(ValueError, match="order_by"):
        clean.clean(df, False, "median", ["d"])
    filled = clean.clean(df, False, "median", ["d"], ["i"]).df
    assert by(filled, "i", "d")[2] == dt.date(2026, 1, 1)


def test_iqr_outlier(spark):
    values = [100, 101, 99, 102, 98, 100, 101, 99, 100, 5000]
    df = spark.createDataFrame([(v,) for v in values], "sales long")
    row = stats.iqr_outliers(df, ["sales"]).first()
    assert (row["count"], row["pct"], row["sample_values"]) == (1, 10.0, [5000.0])


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0), (1.0, 7.0)], "a double, b double")
    assert stats.correlations(df, ["a", "b"]).first()["r"] is None
    row = stats.describe(df, ["a"]).first()
    assert (row["skew"], row["kurtosis"], row["std"]) == (0.0, 0.0, 0.0)
    bins = charts.histograms(df, ["a"]).where("count > 0").collect()
    assert [(r["bin"], r["count"]) for r in bins] == [(10, 4)]


def test_histogram_equals_numpy(spark):
    import numpy as np

    values = np.random.default_rng(5).integers(0, 1000, 5000) / 10.0
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts, edges = np.histogram(values, bins=20)
    rows = sorted(charts.histograms(df, ["x"]).collect(), key=lambda r: r["bin"])
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["bin_start"] for r in rows] == pytest.approx(edges[:-1])


def test_scatter_draws_copies_apart(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 300 + [(2.0, 2.0)] * 100, "x double, y double")
    drawn = charts.scatter_sample(df, "x", "y", points=100)
    share = drawn.where("x = 1").count()
    assert drawn.count() == 100 and 50 < share < 95


def test_thinned_line_keeps_small_tables(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, i), float(i)) for i in range(1, 10)], "d timestamp_ntz, v double")
    assert charts.thinned_line(df, "d", "v").count() == 9
    assert [r["y"] for r in charts.thinned_line(df, "d", "v", points=4).collect()] == [1, 3, 5, 7, 9]


def test_dataset_store_and_ingest(spark, tmp_path):
    store = tables.DatasetStore(spark, str(tmp_path))
    raw = spark.createDataFrame(
        [("2026-01-01", 1.0), ("2026-01-02", float("nan")), ("bad", 3.0), ("2026-01-04", 4.0)],
        ["date ", " v"],
    )
    found = tables.ingest(store, "sales", raw)
    assert [(c.name, c.inferred_type) for c in found.columns] == [
        ("date", "datetime"),
        ("v", "numerical"),
    ]
    assert found.missing_cells == 2
    assert store.load("sales").count() == 4
    store.save("sales", store.load("sales").limit(2), cleaned=True)
    assert store.load("sales").count() == 2
    assert store.load("sales", cleaned=False).count() == 4
    with pytest.raises(FileNotFoundError):
        store.load("other")
    with pytest.raises(ValueError):
        store.path("../etc", False)
    with pytest.raises(ValueError, match="nothing to import"):
        tables.ingest(store, "none", raw.limit(0))
    with pytest.raises(ValueError, match="limit"):
        tables.import_table(store, "x", raw, "json", "y", limit=0)


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,region,sales\n2026-01-01,N,1.5\n2026-01-02,S,\n")
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["date", "string", "double"]
    assert profile.profile(df).missing_cells == 1


def test_nested_json(spark, tmp_path):
    flat = tmp_path / "flat.json"
    flat.write_text('[{"region": "N", "sales": 1}, {"region": "S", "sales": 2}]')
    assert nested.read_json(spark, str(flat), multi_line=True).count() == 2
    deep = tmp_path / "deep.json"
    deep.write_text('{"data": {"items": [{"a": 1, "b": {"c": 2}}, {"a": 2}]}}')
    found = nested.read_json(spark, str(deep), "data.items", multi_line=True)
    assert found.columns == ["a", "b.c"]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (2, None)]
    assert nested.read_json(spark, str(deep), "data.items", multi_line=True, limit=1).count() == 1
    with pytest.raises(ValueError, match="no path"):
        nested.read_json(spark, str(deep), "data.other", multi_line=True)
    with pytest.raises(ValueError, match="expected a JSON"):
        nested.flatten(spark.sql("SELECT 'text' AS x"), "x")


@pytest.mark.parametrize("name", ["sales_2026", "_private"])
def test_identifiers(name):
    assert jdbc.validate_identifier(name) == name


@pytest.mark.parametrize(
    "name",
    [
        "sales; DROP TABLE users;--",
        "sales`; DROP TABLE users;--",
        "sales OR 1=1",
        "1table",
        "table name",
        "table-name",
        "",
        "table/**/name",
    ],
)
def test_bad_identifiers(name):
    with pytest.raises(ValueError):
        jdbc.validate_identifier(name)


def test_jdbc_options(spark):
    source = jdbc.JdbcSource("postgresql", "db", "shop", "me", "secret", schema="sales")
    assert source.options()["url"] == "jdbc:postgresql://db:5432/shop"
    assert source.table("orders") == '"sales"."orders"'
    assert "secret" not in repr(source)
    assert jdbc.JdbcSource("mysql", "db", "shop", "me").table("orders") == "`orders`"
    parts = jdbc.Partitioning("id", "0", "1000", 8).options()
    assert parts["numPartitions"] == "8"
    with pytest.raises(ValueError):
        source.table("orders; DROP TABLE x")
    with pytest.raises(ValueError, match="required"):
        jdbc.JdbcSource("mysql", "", "shop", "me")
    with pytest.raises(ValueError, match="Unknown database"):
        jdbc.JdbcSource("sqlite", "db", "shop", "me")
    catalog = spark.createDataFrame(
        [("shop", "b"), ("shop", "a"), ("sys", "x")], "TABLE_SCHEMA string, TABLE_NAME string"
    )
    assert [r[0] for r in jdbc.tables_in_schema(catalog, "shop").collect()] == ["a", "b"]


def test_report_files(spark, sales, tmp_path):
    found = reports.report_tables(sales, order_by=["date"])
    reports.write_report(found, str(tmp_path), "csv")
    assert spark.read.csv(f"{tmp_path}/summary", header=True).count() == 9
    assert spark.read.csv(f"{tmp_path}/columns", header=True).count() == 4
    with pytest.raises(ValueError):
        reports.write_report(found, str(tmp_path), "xlsx")


def test_duplicates_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)] * 2 + [(None, 3)], "x string, y int")
    monkeypatch.setattr(profile, "BROADCAST_HASHES", 0)
    assert tuple(profile.duplicate_count(df).first()) == (50, 53)


def test_chart_tables(spark):
    df = spark.range(100).select(
        F.date_add(F.lit(dt.date(2026, 1, 1)), F.col("id").cast("int")).alias("day"),
        F.col("id").cast("double").alias("a"),
        (F.col("id") * 2.0).alias("b"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"),
    )
    found = charts.chart_tables(df, profile.profile(df))
    assert {name: t.count() for name, t in found.items()} == {
        "histograms": 40,
        "box": 2,
        "bar": 2,
        "scatter": 100,
        "line": 100,
    }


def test_types_near_and_far_from_the_threshold(spark):
    df = spark.range(1000).select(
        (F.col("id") % 15).alias("codes"),
        (F.col("id") % 16).alias("numbers"),
        F.concat(F.lit("k"), F.col("id") % 50).alias("few"),
        F.concat(F.lit("k"), F.col("id") % 51).alias("many"),
        F.concat(F.lit("k"), F.col("id")).alias("ids"),
    )
    assert profile.inferred_types(df, df.columns) == {
        "codes": "categorical",
        "numbers": "numerical",
        "few": "categorical",
        "many": "text",
        "ids": "text",
    }


def test_approximate_profile_keeps_the_types(spark):
    df = spark.range(2000).select(
        (F.col("id") % 15).alias("code"),
        F.col("id").alias("number"),
        F.concat(F.lit("k"), F.col("id") % 100).alias("kind"),
        F.concat(F.lit("k"), F.col("id")).alias("name"),
        F.lit(None).cast("string").alias("empty"),
    )
    exact, rough = profile.profile(df), profile.profile(df, exact_distinct=False)
    assert [c.inferred_type for c in exact.columns] == [c.inferred_type for c in rough.columns]
    for a, b in zip(exact.columns, rough.columns):
        assert b.unique_count == pytest.approx(a.unique_count, rel=0.1)
    assert rough.columns[1].sample_values == ["0", "1999"]
    assert rough.columns[4].sample_values == []
