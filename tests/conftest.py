import datetime as dtm
import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from pyspark.sql import SparkSession  # noqa: E402

from helpers import DAY0  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series_of(spark):
    """(asset, dt, x) rows from {asset: values}, one day apart."""
    def make(values, start=DAY0, name="x"):
        rows = [(a, start + dtm.timedelta(days=i), None if v is None else float(v))
                for a, vs in values.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, f"asset string, dt date, {name} double")
    return make
