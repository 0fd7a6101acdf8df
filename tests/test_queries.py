"""Every registered query on the smallest test tables, next to DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for table in check.TABLES:
        found.execute(f"CREATE VIEW {table} AS FROM '{SF_DIR}/{table}.parquet'")
    return found


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    line = check.compare(spark, connection, name, SF_DIR)
    assert line.startswith(("ok", "rows-only")), line


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
