"""Numbers beyond those of the small tables, against the SQL of the query."""

import pytest
from pyspark.sql import functions as F

from quirespark.functions.kinds import preserved_percentage
from quirespark.plans.scalars import SQL, scl_numbers

ROWS = [
    ("passed", 92_234, 5), ("passed", 2_000_000_000, 7), ("failed", 2_147_483_647, 1), ("failed", 2_147_483_647, 0), ("failed", 2_147_483_647, 0), ("failed", 2_147_483_647, 0),
    ("skipped", 0, 3), ("inconclusive", None, 4), ("inconclusive", 1_000, None), (None, None, None),
]


def test_counts_beyond_64_bits_when_multiplied(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    schema = "status string, imported_node_count int, fidelity_lost_unit_count bigint"
    spark.createDataFrame(ROWS, schema).coalesce(1).write.parquet(str(tmp_path / "baseline_left.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW baseline_left AS SELECT * FROM '{tmp_path}/baseline_left.parquet/*.parquet'")
    columns = "status, huge, nodes, lost, kept_percent, scaled, css"
    want = connection.sql(f"SELECT {columns} FROM ({SQL['scl_numbers']})").fetchall()
    found = [tuple(r) for r in scl_numbers(spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_a_share_is_cut_off_near_the_next_place(spark):
    kept, less, total = (F.col(c) for c in ("kept", "less", "total"))
    row = spark.sql("SELECT 999999999999999L AS kept, 1000000000000000L AS total, -1L AS less").select(preserved_percentage(kept, total), preserved_percentage(less, total)).first()
    assert tuple(row) == (99.999999, 0.0)
