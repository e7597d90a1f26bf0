"""Every registered sheet query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomsheet import model_queries, queries  # noqa: F401  registers its queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    order = lambda r: tuple((v is not None, str(type(v).__name__ == "str"), v if isinstance(v, str) else float(v or 0)) for v in r)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=order)
    table = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in table.description]
    assert sorted(columns) == names
    want = sorted((tuple(dict(zip(columns, r, strict=True))[n] for n in names) for r in table.fetchall()), key=order)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert all(map(same, x, y)), (x, y)


def test_every_query_has_sql():
    assert sorted(queries.QUERIES) == sorted(queries.ORACLES)


def test_queries_over_whole_tables(spark, duck):
    count = lambda table: duck.execute(f"select count(*) from {table}").fetchone()[0]
    assert queries.QUERIES["dependency_jacobi_all"](spark, FOLDER).count() == count("supplier")
    assert queries.QUERIES["edit_tree_move_all"](spark, FOLDER).count() == count("customer")
    assert queries.QUERIES["agg_product_all"](spark, FOLDER).count() == count("(select distinct o_orderpriority from orders)")
