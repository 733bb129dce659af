"""Every registered query against its DuckDB statement on the smallest data."""

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry

TABLES = ("documents", "embeddings", "benchmark", "pages", "labels")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def shown(value):
    return "null" if value is None or value is pd.NA or value != value else str(value)


def table_rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("key", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query(spark, connection, key):
    ours = entry.queries()[key](spark, SMALL).toPandas()
    theirs = connection.execute(entry.oracle_sql()[key]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0 and table_rows(ours) == table_rows(theirs)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["draw", "sig", "doc_id", "ord", "bucket_size", "sentence"]
    assert found.count() > 0
