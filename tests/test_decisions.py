import pytest

from tablewright.operators import insights, recommend, whatif


def rows_of(found):
    return found.recommendations.collect()


@pytest.fixture(scope="module")
def regions(spark):
    def make(rows, kind="long"):
        return spark.createDataFrame(rows, f"region string, sales {kind}")

    return make


def of_type(found, kind):
    return [r for r in rows_of(found) if r["type"] == kind]


def test_segments(regions):
    df = regions([("N", 900), ("N", 900), ("S", 100), ("S", 100)])
    found = recommend.generate_recommendations(df, "sales", ["region"])
    strong = of_type(found, "growth_opportunity")
    assert [(r["value"], r["segment_value"]) for r in strong] == [("N", 1800.0)]
    assert [r["value"] for r in of_type(found, "decline_intervention")] == ["S"]
    assert of_type(found, "data_quality")[0]["title"] == "Review duplicate records"


def test_concentration(regions):
    df = regions([("N", 800), ("N", 800), ("S", 100), ("W", 100)])
    row = of_type(recommend.generate_recommendations(df, "sales", ["region"]), "concentration_risk")[0]
    assert (row["value"], row["segment_value"], row["reference_value"]) == ("N", 1600, 1800)


def test_missing_values(regions):
    df = regions([("N", 100), (None, 200), (None, 300), ("S", 400), (None, 500)])
    row = of_type(recommend.generate_recommendations(df), "data_quality")[0]
    assert (row["column"], row["affected_rows"], row["percentage"]) == ("region", 3, 60.0)
    assert (row["score"], row["priority"]) == (100, "high")


def test_anomalies(regions):
    df = regions([("N", 100)] * 100 + [("N", 10000)])
    found = of_type(recommend.generate_recommendations(df, "sales"), "anomaly_investigation")
    assert len(found) == 1 and found[0]["sample_values"] == [10000.0]
    constant = regions([("N", 5)] * 20)
    assert not of_type(recommend.generate_recommendations(constant, "sales"), "anomaly_investigation")
    few = regions([("N", 1), ("N", 1), ("N", 1), ("N", 100000)])
    assert not of_type(recommend.generate_recommendations(few, "sales"), "anomaly_investigation")


def test_missing_segment_and_label(regions):
    df = regions([("N", 100), ("N", 100), (None, 900), (None, 900)])
    found = recommend.generate_recommendations(df, "sales", ["region", "region"])
    assert "Missing" in {r["value"] for r in rows_of(found)}
    assert found.dimension_columns == ["region"]


def test_scores_and_limits(regions):
    df = regions([("A", 1000000), ("B", 1), ("C", 1), ("D", 1)])
    found = recommend.generate_recommendations(df, "sales", ["region"])
    scores = [r["score"] for r in rows_of(found)]
    assert all(0 <= s <= 100 for s in scores) and scores == sorted(scores, reverse=True)
    many = regions([(c, 10 ** i) for i, c in enumerate("ABCDEF")])
    assert len(rows_of(recommend.generate_recommendations(many, "sales", ["region"], 2))) <= 2
    assert len(rows_of(recommend.generate_recommendations(many, "sales", ["region"], 0))) == 1


def test_text_metric_and_rejects(regions):
    df = regions([("N", "a"), ("S", "b")], "string")
    assert recommend.generate_recommendations(df, "sales", ["region"]).valid_metric_rows == 0
    with pytest.raises(ValueError):
        recommend.generate_recommendations(df, "nope")
    with pytest.raises(ValueError):
        recommend.generate_recommendations(df, "sales", ["nope"])
    with pytest.raises(ValueError, match="empty"):
        recommend.generate_recommendations(df.limit(0))


@pytest.fixture(scope="module")
def stores(spark):
    return spark.createDataFrame(
        [(100, "North", 10), (200, "South", 20), (300, "West", 30), (400, "West", 40)],
        "sales long, region string, profit long",
    )


def test_what_if(stores):
    row = whatif.run_what_if(stores, "sales", 10).first()
    assert (row["baseline_total"], row["projected_total"]) == (1000, 1100)
    assert row["absolute_impact"] == pytest.approx(100)
    up = whatif.run_what_if(stores, "sales", 15, "region", "West").first()
    assert (up["baseline_segment"], up["projected_segment"]) == (700, 805)
    assert (up["projected_total"], up["percentage_impact"]) == (1105, 10.5)
    down = whatif.run_what_if(stores, "sales", -20, "region", "West").first()
    assert (down["projected_segment"], down["projected_total"]) == (560, 860)
    assert down["percentage_impact"] == -14


def test_what_if_text_metric(spark):
    df = spark.createDataFrame([("100",), ("200",), ("300",)], "sales string")
    row = whatif.run_what_if(df, "sales", 10).first()
    assert (row["baseline_total"], row["projected_total"]) == (600, 660)
    bad = spark.createDataFrame([("abc",), ("xyz",), (None,)], "sales string")
    with pytest.raises(Exception, match="no numbers in"):
        whatif.run_what_if(bad, "sales", 10).collect()


def test_what_if_rejects(stores):
    with pytest.raises(ValueError):
        whatif.run_what_if(stores, "sales", 10, segment_value="West")
    with pytest.raises(ValueError):
        whatif.run_what_if(stores, "sales", 10, "region")
    with pytest.raises(ValueError):
        whatif.run_what_if(stores, "sales", "10")
    with pytest.raises(ValueError):
        whatif.run_what_if(stores, "nope", 10)
    with pytest.raises(Exception, match="no numbers in 'sales' where"):
        whatif.run_what_if(stores, "sales", 10, "region", "Mars").collect()


def test_scenarios(stores):
    found = whatif.run_scenarios(
        stores, "sales", [("region", "West", 15), ("region", "North", -10), ("region", "Mars", 5)]
    )
    totals = {r["segment_value"]: r["projected_total"] for r in found.collect()}
    assert totals == {"West": 1105, "North": 990, "Mars": None}


def test_insights(spark):
    clean = spark.createDataFrame([(float(i), float((i * 7) % 10)) for i in range(10)], "a double, b double")
    assert [r["type"] for r in insights.generate_insights(clean).collect()] == ["summary"]
    messy = spark.createDataFrame(
        [(float(i), i * 2.0, None) for i in range(40)] + [(1e6, 2e6, "x")] * 2,
        "a double, b double, c string",
    )
    found = {r["type"] for r in insights.generate_insights(messy).collect()}
    assert found == {"data_quality", "distribution", "correlation", "outliers"}


def test_insights_count_no_distinct_values_of_continuous_columns(spark, monkeypatch):
    from tablewright.operators import profile

    def refused(df, columns):
        raise AssertionError(columns)

    monkeypatch.setattr(profile, "distinct_counts", refused)
    table = spark.range(1000).selectExpr("id", "id * id * 1.5D AS squares")
    found = {(r["type"], r["title"]) for r in insights.generate_insights(table).collect()}
    assert found == {("correlation", "'id' and 'squares' are strongly correlated")}
