"""Chains and trees of rows that point to other rows.

A row points to at most one other (a fallback, a parent). Where a chain ends, how long it is and whether it runs in a circle
is found by doubling: each round every row takes what the row it points to knows, so that chains of n rows take log2(n)
rounds, and no chain is ever held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.session import cut


def chain_ends(links: DataFrame, keys: Sequence[str], node: str, target: str) -> DataFrame:
    """JON3, TRE5, TRE6: keys, node, last, steps, is_circular: where the chain from each node leads within its keys.

    links: at most one row counts for a node, that with the least target; null nodes are left out. A target that is no node
    ends the chain and counts as its last. is_circular is true for nodes in a circle or on the way to one; last is null and
    steps too then. A node without target is its own end.
    """
    by = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    base = links.where(F.col(f"`{node}`").isNotNull()).select(*by, F.col(f"`{node}`").alias("node"), F.col(f"`{target}`").alias("to"))
    base = cut(base.groupBy(*names, "node").agg(F.min("to").alias("to")))
    state = base.select(*names, "node", F.coalesce("to", "node").alias("last"), F.col("to").isNotNull().cast("bigint").alias("steps"), F.col("to").isNotNull().alias("on"))
    n = base.count()
    reach = 1
    while True:
        known = state.select(*[F.col(c).alias(f"o_{c}") for c in names], F.col("node").alias("o_node"), F.col("last").alias("o_last"), F.col("steps").alias("o_steps"), F.col("on").alias("o_on"))
        same = state["last"] == known["o_node"]
        for c in names:
            same = same & state[c].eqNullSafe(known[f"o_{c}"])
        joined = state.join(known, same & state["on"], "left")
        moves = F.col("on") & F.col("o_node").isNotNull()
        state = cut(
            joined.select(
                *names, "node", F.when(moves, F.col("o_last")).otherwise(F.col("last")).alias("last"),
                F.when(moves, F.col("steps") + F.col("o_steps")).otherwise(F.col("steps")).alias("steps"), (moves & F.col("o_on")).alias("on"),
            )
        )
        reach *= 2
        if reach > n or state.where("on").isEmpty():  # who still goes on after as many steps as there are nodes runs in a circle
            break
    circular = F.col("on")
    return state.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("node").alias(node), F.when(~circular, F.col("last")).alias("last"),
        F.when(~circular, F.col("steps")).alias("steps"), circular.alias("is_circular"),
    )


def tree_index(nodes: DataFrame, doc: str = "doc_id", node: str = "node_id", parent: str = "parent_id", order: str = "ord") -> DataFrame:
    """TRE1, TRE4: nodes and depth, path (node identifiers from the root down), root_id, places (the order at each level).

    Rows sorted by places are in reading order. A node whose parent isn't in its document is a root; nodes in a circle have
    null depth and path. Node identifiers must be unique in a document (see validation for those that aren't).
    """
    key = [F.col(f"`{doc}`").alias("d"), F.col(f"`{node}`").alias("n")]
    known = nodes.select(*key).distinct()
    up = nodes.select(*key, F.col(f"`{parent}`").alias("p"), F.col(f"`{order}`").cast("bigint").alias("o"))
    exists = known.select(F.col("d").alias("pd"), F.col("n").alias("pn"))
    up = up.join(exists, up["d"].eqNullSafe(exists["pd"]) & (up["p"] == exists["pn"]), "left").select("d", "n", F.col("pn").alias("p"), "o")
    state = cut(up.select("d", "n", F.array("n").alias("path"), F.array("o").alias("places"), F.col("p").alias("next")))
    count, reach = state.count(), 1
    while reach <= count and not state.where("next IS NOT NULL").isEmpty():
        other = state.select(F.col("d").alias("od"), F.col("n").alias("on"), F.col("path").alias("opath"), F.col("places").alias("oplaces"), F.col("next").alias("onext"))
        joined = state.join(other, state["d"].eqNullSafe(other["od"]) & (state["next"] == other["on"]), "left")
        state = cut(
            joined.select(
                "d", "n", F.coalesce(F.concat("opath", "path"), "path").alias("path"), F.coalesce(F.concat("oplaces", "places"), "places").alias("places"),
                F.col("onext").alias("next"),
            )
        )
        reach *= 2
    whole = F.col("next").isNull()
    found = state.select(
        F.col("d").alias("__d"), F.col("n").alias("__n"), F.when(whole, F.size("path") - 1).alias("depth"), F.when(whole, F.col("path")).alias("path"),
        F.when(whole, F.get("path", F.lit(0))).alias("root_id"), F.when(whole, F.col("places")).alias("places"),
    )
    return nodes.join(found, nodes[doc].eqNullSafe(found["__d"]) & (nodes[node] == found["__n"]), "left").drop("__d", "__n")


def nearest_ancestor(index: DataFrame, wanted: Column, name: str, doc: str = "doc_id", node: str = "node_id", own: bool = False) -> DataFrame:
    """TRE8, TRE9, TRE10: index and the nearest node above each (or the node itself, with own) that wanted is true of.

    Only nodes that are wanted are joined, by the steps of each path.
    """
    some = index.where(wanted).select(F.col(f"`{doc}`").alias("__d"), F.col(f"`{node}`").alias("__a")).distinct()
    steps = index.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{node}`").alias("__node"), F.posexplode("path").alias("__at", "__step"))
    steps = steps if own else steps.where(F.col("__step") != F.col("__node"))
    met = steps.join(some, steps["__doc"].eqNullSafe(some["__d"]) & (steps["__step"] == some["__a"])).groupBy("__doc", "__node").agg(F.max_by("__a", "__at").alias(name))
    return index.join(met, index[doc].eqNullSafe(met["__doc"]) & (index[node] == met["__node"]), "left").drop("__doc", "__node")


def subtree(index: DataFrame, root: Column) -> DataFrame:
    """TRE11: the nodes of a tree below a node, with it."""
    return index.where(F.array_contains("path", root))
