"""Every registered query against its SQL on DuckDB, over the whole tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from catalogue import oracles, queries as catalogue
from check import database, difference
from panelforge.sources import staging_scope

SF = "/root/testdata/sf0.01"
QUERIES, SQL = catalogue.build(), oracles.build()


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    with staging_scope(spark):
        assert difference(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()) is None


def test_queries_without_a_text_dependency():
    code = ("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()))")
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), "True"], said.stderr


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["asset", "dt", "ret", "price_lag", "momentum_zscore", "alpha", "signal"]
    assert df.count() == 2356
