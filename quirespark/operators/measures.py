"""Measures of what a conversion keeps, and small aggregations around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.kinds import preserved_percentage
from quirespark.operators.ordered import running

c = F.col


def repeated(df: DataFrame, key: Column) -> DataFrame:
    """AGG5: key, n_rows of the keys that come more than once; null keys are none."""
    return df.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def worst(df: DataFrame, keys: Sequence[str], status: str, order: Sequence[str]) -> DataFrame:
    """AGG38: keys, worst, and n_<status> for each: the last of a fixed order that a key's rows have, 'none' without any."""
    names = F.array(*[F.lit(s) for s in order])
    rank = F.coalesce(F.array_position(names, c(status)), F.lit(0))
    counts = [F.count_if(c(status) == s).alias(f"n_{s}") for s in order]
    found = df.groupBy(*keys).agg(F.max(rank).cast("int").alias("rank"), *counts)
    return found.select(*keys, F.when(c("rank") > 0, F.get(names, c("rank") - 1)).otherwise("none").alias("worst"), *[f"n_{s}" for s in order])


def measured(source: DataFrame, came: DataFrame) -> DataFrame:
    """AGG27: metric, total, destination, approximated, unsupported, preserved, lost, excess.

    source: metric, resource, forced ("approximated", "unsupported" or null), n; came: metric, n. What a status is forced
    on isn't preserved; of the rest as much is as came out, and what is left is lost. Metrics that weren't there are left out.
    """
    forced = {s: F.coalesce(F.sum(F.when(c("forced") == s, c("n"))), F.lit(0)).alias(s) for s in ("approximated", "unsupported")}
    sums = source.groupBy("metric").agg(F.sum("n").alias("total"), *forced.values())
    both = sums.join(came.select("metric", c("n").alias("destination")), "metric", "left").withColumn("destination", F.coalesce("destination", F.lit(0).cast("bigint")))
    eligible = c("total") - c("approximated") - c("unsupported")
    kept = F.least(eligible, c("destination"))
    return both.select(
        "metric", "total", "destination", "approximated", "unsupported", kept.alias("preserved"), (eligible - kept).alias("lost"), F.greatest(c("destination") - c("total"), F.lit(0).cast("bigint")).alias("excess")
    )


def summary(measures: DataFrame) -> DataFrame:
    """AGG28: total, preserved, lost, preserved_percent of all measures; one row, also for none."""
    sums = measures.agg(*[F.coalesce(F.sum(x), F.lit(0).cast("bigint")).alias(x) for x in ("total", "preserved", "lost")])
    return sums.select("*", preserved_percentage(c("preserved"), c("total")).alias("preserved_percent"))


def allocated(items: DataFrame, most: DataFrame) -> DataFrame:
    """WIN11: metric, resource, allocated: an amount for each metric given to its items in the order of resources.

    items: metric, resource, n (one row each); most: metric, most. Items that get nothing are left out. No metric is one task.
    """
    rows = running(items, ["metric"], ["resource"], {"upto": ("sum", c("n"))}).join(most, "metric")
    left = c("most") - (c("upto") - c("n"))
    return rows.where(left > 0).select("metric", "resource", F.least(c("n"), left).alias("allocated"))


def normalized_levels(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str) -> DataFrame:
    """WIN1: df and normal_level: each level at most one below the normal level before it, the first at most 1.

    The normal level at place i is the least of level j + (i - j) over all places j up to i, and of i itself: a running
    minimum, for which no key has to be one task.
    """
    placed = running(df, keys, order, {"__place": ("count", F.lit(1))})
    least = running(placed, keys, [*order, "__place"], {"__least": ("min", c(level) - c("__place"))})
    return least.select(*df.columns, (c("__place") + F.least(c("__least"), F.lit(0))).cast("int").alias("normal_level"))
