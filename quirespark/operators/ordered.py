"""Ordered state without a hot group: numbers, running aggregates and predecessors over rows in order within keys.

A window over a key is one task's work, however many rows the key has. Here the rows are cut into ranges by key and order,
so that a large key lies in many ranges; each range is gone through by itself, and what the ranges of a key before it hold
is brought in as one row a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.session import cut

_RANGE = "__range"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df cut into ranges by keys and order, each row with the number of its range.

    Rows of equal keys and order can lie on both sides of an edge; where they must be told apart, order has to do so.
    """
    cut_up = df.repartitionByRange(*[F.col(f"`{c}`") for c in (*keys, *order)])
    return cut(cut_up.withColumn(_RANGE, F.spark_partition_id()))


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """df and, by name, aggregates ("sum", "min", "max" or "count" of a column) of each key's rows up to each row.

    Nulls don't count; an aggregate of nulls only is null, a count 0. Rows of equal order come in any order, one after
    another. Keys may be null. An empty table stays empty.
    """
    parts = df
    for name, (_, column) in values.items():
        parts = parts.withColumn(f"__in_{name}", column)
    parts = ranged(parts, keys, order)
    by_key = [F.col(f"`{k}`") for k in keys]
    inside = Window.partitionBy(_RANGE, *by_key).orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy(_RANGE, *by_key).agg(*[_FOLD[kind](f"__in_{name}").alias(f"__of_{name}") for name, (kind, _) in values.items()])
    # one row for each range a key lies in
    before = Window.partitionBy(*by_key).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    folds = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    carried = sums.select(
        F.col(_RANGE).alias("__of_range"),
        *[c.alias(f"__key_{i}") for i, c in enumerate(by_key)],
        *[folds[kind](f"__of_{name}").over(before).alias(f"__of_{name}") for name, (kind, _) in values.items()],
    )
    local = parts
    for name, (kind, _) in values.items():
        local = local.withColumn(f"__own_{name}", _FOLD[kind](f"__in_{name}").over(inside))
    same = local[_RANGE] == carried["__of_range"]
    for i, c in enumerate(keys):
        same = same & local[c].eqNullSafe(carried[f"__key_{i}"])
    both = local.join(carried, same, "left")
    out = [local[c] for c in df.columns]
    for name, (kind, _) in values.items():
        own, earlier = F.col(f"__own_{name}"), F.col(f"__of_{name}")
        if kind in ("sum", "count"):
            one = F.coalesce(own + earlier, own, earlier)
        else:
            one = (F.least if kind == "min" else F.greatest)(own, earlier)
        out.append(one.alias(name))
    return both.select(*out)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """df and the place of each row among those of its key, from 1. Equal rows are numbered in any order."""
    return running(df, keys, order, {name: ("count", F.lit(1))})


def preceded(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """df and, by name, what a column of the row before holds within the key; null for the first row of a key."""
    parts = ranged(df, keys, order)
    by_key = [F.col(f"`{k}`") for k in keys]
    by_order = [F.col(f"`{c}`") for c in order]
    inside = Window.partitionBy(_RANGE, *by_key).orderBy(*by_order)
    last = F.struct(F.lit(True).alias("is"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(values.values())])
    marked = parts.withColumn("__last", last).withColumn("__own", F.lag("__last").over(inside))
    tail = marked.groupBy(_RANGE, *by_key).agg(F.max_by("__last", F.struct(*by_order)).alias("__tail"))
    before = Window.partitionBy(*by_key).orderBy(_RANGE)
    carried = tail.select(F.col(_RANGE).alias("__of_range"), *[c.alias(f"__key_{i}") for i, c in enumerate(by_key)], F.lag("__tail").over(before).alias("__earlier"))
    same = marked[_RANGE] == carried["__of_range"]
    for i, c in enumerate(keys):
        same = same & marked[c].eqNullSafe(carried[f"__key_{i}"])
    both = marked.join(carried, same, "left")
    held = F.coalesce("__own", "__earlier")
    return both.select(*[marked[c] for c in df.columns], *[held.getField(f"v{i}").alias(name) for i, name in enumerate(values)])
