"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as driver
from oracle import connect, differences
from tidemark.plans import all_oracles, all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    before = spark.sql("SET").collect()
    df = driver.queries()[name](spark, SF_DIR)
    assert spark.sql("SET").collect() == before, "a session setting was left changed"
    assert differences(df, connection, driver.oracle_sql()[name]) == []


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["k", "n"]
    assert df.agg({"n": "sum"}).first()[0] == 1000
