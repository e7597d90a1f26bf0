"""Sheet queries against their SQL in DuckDB on tables with values that the given ones lack."""

import duckdb
from pyspark.sql import functions as F

from loomsheet import model_queries, queries  # noqa: F401  registers its queries
from loomsheet.operators import references


def both(spark, folder, name, **tables):
    """The query's rows and those of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.execute(f"copy ({rows}) to '{folder}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(folder)).select(names).collect()]
    return sorted(got, key=order), sorted(found.fetchall(), key=order)


def test_columns_halfway_go_to_the_even_one(spark, tmp_path):
    orders = "select i as o_orderkey, 3 * i as o_custkey, 5000.0::double * i as o_totalprice from range(60) r(i)"
    supplier = "select i as s_suppkey, (i % 25)::int as s_nationkey from range(25) r(i)"
    got, want = both(spark, tmp_path, "lookup_range_join", orders=orders, supplier=supplier)
    assert got and got == want


def test_areas_lie_beyond_the_rows_of_a_sheet_and_halves_round_alike(spark, tmp_path):
    supplier = "select i + 1048560 as s_suppkey, (i % 25)::int as s_nationkey, i * 0.3::double + 0.005::double as s_acctbal from range(90) r(i)"
    part = "select i as p_partkey, i::int as p_size, 9.5::double as p_retailprice from range(3) r(i)"
    got, want = both(spark, tmp_path, "ref_offset_area", supplier=supplier, part=part)
    assert len(got) == 90 and got == want


def test_areas_of_repeated_keys(spark, tmp_path):
    supplier = "select (i % 20)::bigint as s_suppkey, (i * 7 % 25)::int as s_nationkey, i * 0.25::double as s_acctbal from range(60) r(i)"
    part = "select i as p_partkey, i::int as p_size, 9.5::double as p_retailprice from range(3) r(i)"
    got, want = both(spark, tmp_path, "ref_offset_area", supplier=supplier, part=part)
    assert len(got) > 20 and got == want


def test_areas_of_a_sheet_keep_its_limits(spark):
    one = lambda x: spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(x))).first()
    at = lambda top, **limits: one(references.offset_area(F.lit(top), F.lit(1), F.lit(0), F.lit(0), **limits))
    assert at(1_048_576)[4] is None and at(1_048_577)[4] == "#REF!"
    assert at(1_048_577, limits=None)[0] == 1_048_577
