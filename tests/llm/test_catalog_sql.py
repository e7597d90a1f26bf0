"""Every corpus query that has SQL, whole rows and columns, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from loomsheet.llm import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    table = con.execute(catalog.oracle_sql()[name])
    assert sorted(d[0] for d in table.description) == columns
    places = [[d[0] for d in table.description].index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in places)) for row in table.fetchall())
    assert sorted(repr(tuple(row)) for row in df.select(*columns).collect()) == want
