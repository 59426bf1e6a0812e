import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    found = entry.entry(spark)
    assert found.count() > 0
    assert found.columns[:2] == ["dimension", "value"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


# One query of each family; tools/check_oracle.py runs them all.
@pytest.mark.parametrize(
    "name",
    [
        "aggregate",
        "group_by_median_bracketed",
        "trend_quarter_median",
        "profile_columns",
        "describe_bracketed",
        "histograms",
        "root_cause_comparable_contributors",
        "recommendations",
        "what_if_scenarios",
        "clean_auto",
        "forward_fill_by_group",
        "read_nested_json",
        "forecast_linear",
        "classification_scores",
        "stratified_split",
    ],
)
def test_agrees_with_sql(spark, name):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    ok, note = compare(
        spark, connect(SMALL), entry.queries()[name], entry.oracle_sql()[name], SMALL
    )
    assert ok, note
