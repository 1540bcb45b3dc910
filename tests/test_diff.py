"""Differences of two copies against a plain comparison, and the notations that mean the same."""

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.operators.diff import canonical_count, canonical_digest, differences

SCHEMA = "pub_id string, captured_at timestamp, n string, h string, t string, key string, side string"
FIELDS = {"n": "count", "h": "digest", "t": "text"}


def rows(spark, values):
    return spark.createDataFrame([(k, at and datetime(2024, 1, at), n, h, t, "x", "y") for k, at, n, h, t in values], SCHEMA)


def found(spark, left, right, **more):
    return sorted(tuple(r) for r in differences(rows(spark, left), rows(spark, right), "pub_id", "captured_at", FIELDS, **more).collect())


def test_each_kind_of_difference(spark):
    left = [("A", 1, "1", "ab", "x"), (" a ", 2, "2", "ab", None), ("b", 1, "1", None, None), ("c", None, "5", "q", "t"), ("c", None, "5", "q", "t")]
    right = [("a", 3, "2.0", "SHA256:AB", " "), ("d", 1, "1", None, None), ("C", 1, "6", "q", "\x00")]
    assert found(spark, left, right) == [("b", "left_only", ""), ("c", "differs", "n"), ("c", "differs", "t"), ("d", "right_only", "")]
    assert found(spark, left, left) == [] and found(spark, [], []) == []
    assert ("c", "differs", "n", "5", "6") in found(spark, left, right, values=True)


def test_null_is_no_text_and_null_keys_are_one(spark):
    assert found(spark, [("k", 1, None, None, None)], [("k", 1, None, None, "\x00")]) == [("k", "differs", "t")]
    assert [r[1] for r in found(spark, [(None, 1, "1", "a", "b"), (" ", 2, "1", "a", "b")], [])] == ["left_only"]


def test_notations_of_counts(spark):
    same = ["1234", "+1234", " 1,234 ", "1.234", "1'234", "1 234", "1 234", "1_234", "1234.0", "1.234,00", "1,234.00", "12.34e2", "١٢٣٤", "１２３４", "1234,0"]
    df = spark.createDataFrame([(x,) for x in same], "x string").select(canonical_count(F.col("x")).alias("c"))
    assert {r.c for r in df.collect()} == {"1234"}
    odd = spark.createDataFrame([("12.5",), ("x",), ("",), (None,), ("-0003",), ("−3",)], "x string").select(canonical_count(F.col("x")).alias("c"))
    assert [r.c for r in odd.collect()] == ["12.5", "x", None, None, "-3", "-3"]


def test_what_a_point_means_is_told_by_the_column(spark):
    assert found(spark, [("a", 1, "12", None, None), ("b", 1, "3", None, None)], [("a", 1, "12.000", None, None), ("b", 1, "3.0", None, None)]) == []
    assert found(spark, [("a", 1, "12000", None, None), ("b", 1, "1234567", None, None)], [("a", 1, "12.000", None, None), ("b", 1, "1.234.567", None, None)]) == []


def test_digests(spark):
    df = spark.createDataFrame([("ab12",), (" AB12 ",), ("sha256:ab12",), ("SHA-512/256: AB12",), ("md5=AB12",)], "x string")
    assert {r[0] for r in df.select(canonical_digest(F.col("x"))).collect()} == {"AB12"}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(1, 3), st.sampled_from([None, "1", "2"])), max_size=12), st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(1, 3), st.sampled_from([None, "1", "2"])), max_size=12))
def test_against_a_plain_comparison(spark, left, right):
    left = list({(k, at): (k, at, n, None, None) for k, at, n in left}.values())
    right = list({(k, at): (k, at, n, None, None) for k, at, n in right}.values())

    def latest(side):
        return {k: max((r for r in side if r[0] == k), key=lambda r: r[1])[2] for k in {r[0] for r in side}}

    one, other = latest(left), latest(right)
    want = [(k, "left_only", "") for k in one if k not in other] + [(k, "right_only", "") for k in other if k not in one]
    want += [(k, "differs", "n") for k in one if k in other and one[k] != other[k]]
    assert found(spark, left, right, leaf_rows=2) == sorted(want)
