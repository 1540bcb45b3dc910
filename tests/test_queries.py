"""Queries against their SQL on small tables."""

import os

import pytest

import __spark_entry__
from quirespark import plans
from quirespark.session import TABLES

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    if hasattr(value, "__float__"):
        return str(round(float(value), 6))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_and_sql_agree(spark, duck, name):
    found = plans.QUERIES[name](spark, TESTDATA)
    columns = sorted(found.columns)
    said = duck.sql(plans.SQL[name])
    assert sorted(said.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({plans.SQL[name]})").fetchall()
    rows = found.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_the_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"p1_found", "p2_found"} <= set(__spark_entry__.queries())
