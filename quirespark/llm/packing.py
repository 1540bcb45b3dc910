"""Filling containers of fixed capacity with whole texts.

A container has three limits at once: tokens, segments and loss-bearing tokens. Items are spread over blocks of bounded
size, and each block is packed by the dot-product rule: of all items that still fit, the open container takes the one whose
sizes point most nearly along the space that is left. A block leaves at most its last containers partly empty.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.session import cut

#: Items packed together in one task. Larger blocks waste fewer last containers, smaller ones need less time and memory.
BLOCK_ITEMS = 20_000
#: Containers that may be asked for at once; the table of limits is the only thing the driver gathers.
MOST_LIMITS = 1_000
#: The limit of a dimension for which none is given; no container reaches it.
NO_LIMIT = 2**62

OUT = "limit_id int, container bigint, slot int, {key} {kind}, part_no int, start_token bigint, n_tokens bigint, n_segments bigint, n_loss bigint"


def dot_product_packing(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container (from 0) of each item; sizes is items x dimensions, each within limits.

    One container is open at a time. The score of an item is the dot product of its sizes and the space left, both
    relative to the limits, with each dimension weighted by its share of the total demand; equal scores go to the larger
    item, then to the earlier one in the order of sizes. Dimensions of which all items together fit one container don't count.
    """
    container = np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return container
    if (sizes > limits).any():
        raise ValueError(f"an item of {sizes[(sizes > limits).any(axis=1)][0].tolist()} exceeds the limits {list(map(int, limits))} of an empty container")
    counted = [d for d in range(sizes.shape[1]) if float(sizes[:, d].sum(dtype=float)) > limits[d]]
    sizes, limits = sizes[:, counted], limits[counted]
    if not counted:
        return container
    first = sizes[:, 0].astype(object) if len(counted) > 1 else None
    if len(counted) == 1 or all((first * int(limits[d]) == sizes[:, d].astype(object) * int(limits[0])).all() for d in range(1, len(counted))):
        return _largest_first(sizes[:, 0], int(limits[0]))
    distinct, inverse, counts = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    members = np.argsort(inverse.ravel(), kind="stable")
    taken = np.concatenate([[0], np.cumsum(counts)[:-1]])
    relative = distinct / limits
    demand = (relative * counts[:, None]).sum(axis=0)
    weighted = relative * (demand / max(demand.sum(), 1e-12))
    size = relative.sum(axis=1)
    left, kinds, placed, number = counts.copy(), np.arange(len(distinct)), 0, 0
    space = limits.astype(np.int64).copy()
    may = kinds
    while placed < len(sizes):
        may = may[(left[may] > 0) & (distinct[may] <= space).all(axis=1)]
        if not len(may):
            number += 1
            space = limits.astype(np.int64).copy()
            kinds = kinds[left[kinds] > 0]
            may = kinds
            continue
        score = weighted[may] @ (space / limits)
        best = score.max()
        equal = may[score >= best - 1e-12]
        kind = equal[np.argmax(size[equal])]
        container[members[taken[kind]]] = number
        taken[kind] += 1
        left[kind] -= 1
        placed += 1
        space -= distinct[kind]
    return container


def _largest_first(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The same packing where all dimensions are one: the open container takes the largest item that fits."""
    distinct, inverse, counts = np.unique(sizes, return_inverse=True, return_counts=True)
    members = np.argsort(inverse, kind="stable")
    taken = (np.cumsum(counts) - counts).tolist()
    left, values, members = counts.tolist(), distinct.tolist(), members.tolist()
    lower = list(range(-1, len(values) - 1))  # the next smaller size, past those that are used up
    container, number, space = np.zeros(len(sizes), dtype=np.int64), 0, capacity
    for _ in range(len(sizes)):
        at = bisect_right(values, space) - 1
        passed = []
        while at >= 0 and not left[at]:
            passed.append(at)
            at = lower[at]
        for i in passed:
            lower[i] = at
        if at < 0:
            number, space = number + 1, capacity
            at = len(values) - 1
            while not left[at]:
                at = lower[at]
            lower[len(values) - 1] = at if at < len(values) - 1 else lower[-1]
        container[members[taken[at]]] = number
        taken[at] += 1
        left[at] -= 1
        space -= values[at]
    return container


def pack(
    items: DataFrame,
    limits: DataFrame,
    key: str = "doc_id",
    tokens: str = "n_tokens",
    segments: str | None = None,
    loss: str | None = None,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The container of each item under each row of limits.

    items: key and sizes. Without a column of segments an item is one; without one of loss all its tokens bear loss.
    limits: limit_id, capacity_tokens, and optionally max_segments and max_loss.
    Out: limit_id, container, slot (order inside), key, part_no, start_token, n_tokens, n_segments, n_loss.

    Only an item that exceeds a limit is divided: into parts as large as the limits allow and a rest, which is packed like
    an item. An item without tokens (null, empty) takes a slot but no space. Null sizes count as 0, null keys are items,
    repeated rows are items of their own. An empty table gives no row. Other columns aren't read.

    Equal items are counted before they are shuffled, and each count is spread over the blocks, so neither a hot key nor the
    order of the rows makes a large group, and the result doesn't depend on the partitions.
    """
    rows = limits.collect() if limits.limit(MOST_LIMITS + 1).count() <= MOST_LIMITS else None
    if rows is None:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    kind = items.schema[key].dataType.simpleString()
    whole = F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("bigint"), F.lit(0)), F.lit(0))
    base = items.select(
        F.col(f"`{key}`").alias("key"),
        whole.alias("tokens"),
        (F.coalesce(F.col(f"`{segments}`").cast("bigint"), F.lit(0)) if segments else F.lit(1).cast("bigint")).alias("segments"),
        (F.least(F.coalesce(F.col(f"`{loss}`").cast("bigint"), F.lit(0)), whole) if loss else whole).alias("loss"),
    )
    known: dict[int, np.ndarray] = {}
    asked = []
    for row in rows:
        r: dict[str, Any] = row.asDict()
        if r["capacity_tokens"] is None:
            raise ValueError(f"limit {r['limit_id']} has no capacity")
        capacity = int(r["capacity_tokens"])
        most = np.array([capacity, int(r.get("max_segments") or NO_LIMIT), int(r.get("max_loss") or capacity)])
        known[int(r["limit_id"])] = most
        asked.append(F.struct(F.lit(int(r["limit_id"])).alias("id"), *[F.lit(int(x)).cast("bigint").alias(n) for x, n in zip(most, ("c", "s", "l"), strict=True)]))
    if not asked:
        asked = [F.struct(*[F.lit(1).alias(n) for n in ("id", "c", "s", "l")])]
        base = base.limit(0)
    base = cut(base.groupBy("key", "tokens", "segments", "loss").agg(F.count("*").alias("copies")))
    each = base.withColumn("limit", F.explode(F.array(*asked)))
    step = F.least(
        F.col("limit.c").cast("bigint"),
        F.when(F.col("loss") > F.col("limit.l"), F.greatest(F.lit(1), F.floor(F.col("tokens") * F.col("limit.l") / F.col("loss")))),
        F.when(F.col("segments") > F.col("limit.s"), F.greatest(F.lit(1), F.floor(F.col("tokens") * F.col("limit.s") / F.col("segments")))),
    )
    # with fewer tokens than parts, an item is divided by its segments, and so many parts share its tokens
    thin = (F.col("segments") > F.col("limit.s")) & (F.col("tokens") * F.col("limit.s") < F.col("segments"))
    each = each.withColumn("step", step).withColumn("n_parts", F.when(thin, F.ceil(F.col("segments") / F.col("limit.s"))))
    last = F.coalesce("n_parts", F.ceil(F.col("tokens") / F.col("step"))) - 1
    parts = each.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), last))))

    def thin_share(column: str, at: F.Column) -> F.Column:
        return F.floor(at * F.col(column) / F.col("n_parts"))

    start = F.coalesce(thin_share("tokens", F.col("part_no")), F.col("part_no") * F.col("step"))
    end = F.coalesce(thin_share("tokens", F.col("part_no") + 1), F.least(F.col("tokens"), F.col("part_no") * F.col("step") + F.col("step")))

    def share(column: str) -> F.Column:
        of = F.col(column)
        thinly = thin_share(column, F.col("part_no") + 1) - thin_share(column, F.col("part_no"))
        cut = F.when(F.col("tokens") > 0, F.floor(end * of / F.col("tokens")) - F.floor(start * of / F.col("tokens")))
        return F.coalesce(thinly, cut, of)

    parts = parts.select(
        F.col("limit.id").alias("limit_id"), "key", "copies", F.col("part_no").cast("int").alias("part_no"), start.alias("start_token"),
        (end - start).alias("n_tokens"), F.greatest(share("segments"), F.least(F.col("segments"), F.lit(1))).alias("n_segments"),
        share("loss").alias("n_loss"), F.xxhash64("key", "part_no", "tokens", "segments", "loss").alias("salt"),
    )
    held = {r["limit_id"]: r["n"] for r in parts.groupBy("limit_id").agg(F.sum("copies").alias("n")).collect()}
    blocks = F.coalesce(*[F.when(F.col("limit_id") == i, F.lit(-(-n // block_items)).cast("bigint")) for i, n in held.items()], F.lit(1).cast("bigint"))
    # of n copies each block gets n // blocks, and as many of the blocks from the salt on one more
    spread = parts.withColumn("blocks", blocks).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("copies", "blocks") - 1)))
    salted = spread.withColumn("block", F.pmod(F.col("salt") + F.col("i"), F.col("blocks"))).withColumn(
        "copies", F.floor(F.col("copies") / F.col("blocks")) + (F.col("i") < F.col("copies") % F.col("blocks")).cast("bigint")
    ).drop("salt", "i", "blocks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])] if (pdf["copies"] != 1).any() else pdf
        pdf = pdf.sort_values(["n_tokens", "key", "part_no"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = pdf[["n_tokens", "n_segments", "n_loss"]].to_numpy(dtype=np.int64)
        pdf["container"] = dot_product_packing(sizes, known[int(pdf["limit_id"].iat[0])]) + (int(pdf["block"].iat[0]) << 32)
        pdf["slot"] = pdf.groupby("container").cumcount().astype(np.int32)
        return pdf.rename(columns={"key": key})[["limit_id", "container", "slot", key, "part_no", "start_token", "n_tokens", "n_segments", "n_loss"]]

    return salted.groupBy("limit_id", "block").applyInPandas(run, OUT.format(key=f"`{key}`", kind=kind))


def containers(packed: DataFrame) -> DataFrame:
    """limit_id, container, n_items, used_tokens, used_segments, used_loss of a packing."""
    return packed.groupBy("limit_id", "container").agg(
        F.count("*").alias("n_items"),
        F.sum("n_tokens").alias("used_tokens"),
        F.sum("n_segments").alias("used_segments"),
        F.sum("n_loss").alias("used_loss"),
    )


def fit_rate(sizes: np.ndarray, container: np.ndarray, capacity: int) -> float:
    """The share of the containers' tokens that is used."""
    return float(sizes[:, 0].sum() / ((int(container.max()) + 1) * capacity)) if len(sizes) else 1.0

