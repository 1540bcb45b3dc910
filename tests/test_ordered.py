"""Ordered state and chains against windows and plain walks, with keys that lie in many ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirespark.operators.chains import chain_ends, nearest_ancestor, subtree, tree_index
from quirespark.operators.ordered import numbered, preceded, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(2000)]
    return spark.createDataFrame(data, "k string, o int, v int").repartition(5)


def test_running_aggregates(rows):
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("least"), F.count("v").over(w).alias("n"))
    found = running(rows, ["k"], ["o"], {"s": ("sum", F.col("v")), "least": ("min", F.col("v")), "n": ("count", F.col("v"))})
    assert sorted(map(str, want.collect())) == sorted(map(str, found.collect()))


def test_numbers_and_predecessors(rows):
    w = Window.partitionBy("k").orderBy("o")
    assert sorted(map(str, rows.select("*", F.row_number().over(w).alias("number")).collect())) == sorted(map(str, numbered(rows, ["k"], ["o"]).collect()))
    want = rows.select("*", F.lag("v").over(w).alias("was"), F.lag("o").over(w).alias("at"))
    assert sorted(map(str, want.collect())) == sorted(map(str, preceded(rows, ["k"], ["o"], {"was": "v", "at": "o"}).collect()))
    assert numbered(rows.limit(0), ["k"], ["o"]).collect() == [] and preceded(rows.limit(0), ["k"], ["o"], {"was": "v"}).collect() == []


def test_chains(spark):
    rng = random.Random(2)
    links = {(k, i): rng.choice([None, *range(14)]) for k in "xy" for i in range(12)}
    df = spark.createDataFrame([(k, str(i), None if t is None else str(t)) for (k, i), t in links.items()], "k string, n string, t string")

    def walk(k, i):
        seen, at = [], i
        while (k, at) in links and links[k, at] is not None:
            if at in seen:
                return (None, None, True)
            seen.append(at)
            at = links[k, at]
        return (str(at), len(seen), False)

    found = {(r.k, int(r.n)): (r["last"], r.steps, r.is_circular) for r in chain_ends(df, ["k"], "n", "t").collect()}
    assert found == {key: walk(*key) for key in links}
    assert chain_ends(df.limit(0), ["k"], "n", "t").collect() == []


def test_a_long_chain_and_a_tree(spark):
    n = 300
    df = spark.createDataFrame([("d", str(i), str(i + 1) if i < n else None) for i in range(n + 1)], "d string, n string, t string")
    assert {r.steps for r in chain_ends(df, ["d"], "n", "t").where("n = '0'").collect()} == {n}
    nodes = [("d", "r", None, 0, "chapter"), ("d", "a", "r", 0, "section"), ("d", "b", "a", 1, "text"), ("d", "c", "a", 0, "text"), ("d", "x", "y", 0, "text"), ("d", "y", "x", 0, "text"), ("e", "r", "gone", 3, "text")]
    index = tree_index(spark.createDataFrame(nodes, "doc_id string, node_id string, parent_id string, ord int, kind string"))
    found = {(r.doc_id, r.node_id): r.path for r in index.collect()}
    assert found == {("d", "r"): ["r"], ("d", "a"): ["r", "a"], ("d", "b"): ["r", "a", "b"], ("d", "c"): ["r", "a", "c"], ("d", "x"): None, ("d", "y"): None, ("e", "r"): ["r"]}
    assert [r.node_id for r in index.where("doc_id = 'd' AND path IS NOT NULL").orderBy("places").collect()] == ["r", "a", "c", "b"]
    near = nearest_ancestor(index, F.col("kind") == "chapter", "chapter_id")
    assert {(r.doc_id, r.node_id): r.chapter_id for r in near.collect() if r.chapter_id} == {("d", "a"): "r", ("d", "b"): "r", ("d", "c"): "r"}
    assert subtree(index, F.lit("a")).count() == 3
