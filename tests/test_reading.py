"""CSV records, dates, native comparison, and inputs beyond former limits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.durable import delete_written, shared_folder, written
from tablewright.forecast.prepare import prepare
from tablewright.functions.coerce import timestamp
from tablewright.ml.density import dbscan
from tablewright.operators.charts import category_counts, histograms
from tablewright.operators.clean import drop_duplicate_rows
from tablewright.operators.profile import duplicate_count
from tablewright.operators.query import group_by
from tablewright.sources.nested import flatten, flatten_json_column
from tablewright.sources.tables import DatasetStore, import_table, read_csv


@pytest.fixture
def csv(tmp_path):
    def write(text):
        (tmp_path / "t.csv").write_text(text)
        return str(tmp_path / "t.csv")

    return write


def test_csv_quotes_breaks_and_missing_tokens(spark, csv):
    path = csv('id,name,amount,day,flag\n1,"a ""b"" c",1.5,2024-01-02,true\n2,"x\ny, z",NA,2024-01-03,false\n3,null,2,,TRUE\n')
    read = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in read.schema] == ["int", "string", "double", "date", "boolean"]
    rows = sorted(read.collect())
    assert rows[0].name == 'a "b" c' and rows[1].name == "x\ny, z" and rows[2].name is None
    assert [r.amount for r in rows] == [1.5, None, 2.0] and rows[2].day is None


def test_csv_with_a_schema(spark, csv):
    read = read_csv(spark, csv("id,v\n1,2.5\n2,oops\n3,N/A\n"), "id long, v double")
    assert [r.v for r in read.orderBy("id").collect()] == [2.5, None, None]


def test_csv_malformed_records(spark, csv):
    path = csv("a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(ValueError, match="more cells"):
        read_csv(spark, path)
    kept = read_csv(spark, path, malformed="drop").orderBy("a").collect()
    assert [(r.a, r.b) for r in kept] == [(1, 2), (6, None)]
    with pytest.raises(ValueError, match="line break"):
        read_csv(spark, csv('a,b\n1,"x\ny"\n'), multi_line=False)


DATES = {
    "2024-01-05": (2024, 1, 5),
    "  2024-01-05" + " " * 50: (2024, 1, 5),
    "2024-1-5": (2024, 1, 5),
    "1/5/24": (2024, 1, 5),
    "1/5/99": (1999, 1, 5),
    "5-Jan-2024": (2024, 1, 5),
    "5-Jan-24": (2024, 1, 5),
    "Jan 5 2024": (2024, 1, 5),
    "January 5, 2024 14:30": (2024, 1, 5, 14, 30),
    "5 January 2024": (2024, 1, 5),
    "1/5/2024 2:30 PM": (2024, 1, 5, 14, 30),
    "1/5/2024 12:05:09 am": (2024, 1, 5, 0, 5, 9),
    "2024/1/5 23:59": (2024, 1, 5, 23, 59),
    "5.1.2024": (2024, 1, 5),
    "20240105": (2024, 1, 5),
    "2024-01-05T10:00:00+02:00": (2024, 1, 5, 8),
    "2024-01-05T10:00:00Z": (2024, 1, 5, 10),
    "2024-01-05 10:00:00.5": (2024, 1, 5, 10, 0, 0, 500000),
    "13/45/2024": None,
    "1/5/2024 25:00": None,
    "hello 2024": None,
    "": None,
    "12": None,
}


def test_text_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "d string")
    found = {r.d: r.t for r in rows.select("d", timestamp(rows, "d").alias("t")).collect()}
    assert found == {k: v and dt.datetime(*v) for k, v in DATES.items()}


def test_repeated_hour_is_two_instants(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.createDataFrame([(1698539400,), (1698543000,), (1698543000,)], "s long").select(
            F.timestamp_seconds("s").alias("t")
        )
        assert duplicate_count(rows).first()["duplicate_rows"] == 1
        assert drop_duplicate_rows(rows).count() == 2
        assert group_by(rows.withColumn("v", F.lit(1)), "v", "t", "count").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rows_with_maps_nan_and_zero_signs(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES (map('a', 1, 'b', 2), 0.0D), (map('b', 2, 'a', 1), -0.0D),
           (map('a', 1), double('NaN')), (map('a', 1), double('NaN')) AS t(m, x)"""
    )
    assert duplicate_count(rows).first()["duplicate_rows"] == 2
    assert drop_duplicate_rows(rows).count() == 2 and drop_duplicate_rows(rows).columns == ["m", "x"]


def test_more_repeated_hashes_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tablewright.operators.profile.BROADCAST_HASHES", 2)
    rows = spark.range(40).selectExpr("id % 10 AS a", "id % 5 AS b")
    assert duplicate_count(rows).first()["duplicate_rows"] == 30


def test_charts_take_every_column_and_leave_infinity_out(spark):
    rows = spark.range(20).selectExpr(*[f"cast(id as double) AS c{i}" for i in range(10)])
    assert histograms(rows, rows.columns).select("column").distinct().count() == 10
    assert category_counts(rows, rows.columns).select("column").distinct().count() == 10
    with_infinity = rows.select("c0").union(spark.sql("SELECT double('Infinity')"))
    assert histograms(with_infinity, ["c0"]).agg(F.sum("count")).first()[0] == 20


def test_flattened_names_stay_apart(spark):
    clash = spark.sql("SELECT named_struct('a', named_struct('b', 1), 'a.b', 2) AS d")
    with pytest.raises(ValueError, match="a.b"):
        flatten(clash, "d")
    numbers = spark.createDataFrame([(1, "[1, 2]")], "k int, j string")
    with pytest.raises(ValueError, match="expected a JSON object"):
        flatten_json_column(numbers, "j", keep=["k"])


def test_one_long_series_does_not_stop_the_others(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", day + dt.timedelta(days=i), float(i)) for i in range(10)]
    rows += [("b", day + dt.timedelta(days=i), float(i)) for i in range(9)] + [("b", dt.datetime(2300, 1, 1), 1.0)]
    table = spark.createDataFrame(rows, "k string, d timestamp_ntz, v double")
    found = prepare(table, "d", "v", ["k"], max_steps=1000)
    assert {r.k for r in found.series.select("k").distinct().collect()} == {"a"}
    assert {r.k: r.too_long for r in found.info.collect()} == {"a": False, "b": True}


def test_imports_take_any_limit(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    assert import_table(store, "t", spark.range(50).toDF("a"), "s", "r", limit=300_000).row_count == 50
    with pytest.raises(ValueError):
        import_table(store, "t", spark.range(5).toDF("a"), "s", "r", limit=0)


def test_density_clusters_in_five_features(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.25, (60, 5)) for c in (0, 2)] + [rng.uniform(-6, 6, (15, 5))])
    names = [f"x{i}" for i in range(5)]
    table = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    found = {r.id: r.cluster for r in dbscan(table, names, 0.7, 5).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.49
    core = near.sum(axis=1) >= 5
    assert {i for i, c in found.items() if c < 0} == set(np.flatnonzero(~(near & core[None]).any(axis=1)).tolist())
    label = list(range(len(x)))
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = min(label[j] for j in np.flatnonzero(near[i] & core))
    pairs = {(label[i], found[int(i)]) for i in np.flatnonzero(core)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_written_tables_can_be_deleted(spark, tmp_path):
    kept = written(spark.range(5).toDF("a"), str(tmp_path))
    assert kept.count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert delete_written(spark) >= 1 and not list(tmp_path.iterdir())
    assert shared_folder(spark)
