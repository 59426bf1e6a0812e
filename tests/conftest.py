import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    return spark.createDataFrame(
        [
            ("2026-01-01", "North", "Widget A", 100),
            ("2026-01-10", "South", "Widget B", 200),
            ("2026-02-01", "North", "Widget A", 300),
            ("2026-02-10", "South", "Widget B", 400),
        ],
        "date string, region string, product string, sales long",
    )


@pytest.fixture(scope="session")
def make_dated(spark):
    """Rows of (date, sales, region)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "N") for r in rows]
        return spark.createDataFrame(full, "date string, sales long, region string")

    return make


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


pytest.by = by
pytest.dt = dt
