"""Every registered query beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

import catalog
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_sql_names_are_queries():
    assert set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    _, gap = compare(spark, con, catalog.queries()[name], SQL[name], SF_DIR)
    assert gap == ""


def test_first_int_of_long_runs_equals_sql(spark, tmp_path):
    texts = ["9" * 30, "a " + "8" * 19 + " 7", str(2**63 - 1), str(2**63), "0" * 30 + "7", "none", "", None, "\u0663 4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, con, catalog.queries()["r6_first_int"], SQL["r6_first_int"], str(tmp_path)) == (len(texts), "")
