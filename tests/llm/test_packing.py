"""Items that exceed a limit other than the tokens."""

import numpy as np
import pytest

from quirespark.llm.packing import containers, dot_product_packing, pack

ITEMS = [(1, 0, 100, 0), (2, 3, 40, 2), (3, 25, 1, 25), (4, 30, 33, 12), (5, 7, 2, 0), (6, None, None, None)]



def test_every_part_is_within_three_different_limits(spark):
    items = spark.createDataFrame(ITEMS, "doc_id long, n_tokens long, seg long, loss long")
    limits = spark.createDataFrame([(1, 10, 8, 4)], "limit_id int, capacity_tokens int, max_segments int, max_loss int")
    packed = pack(items, limits, segments="seg", loss="loss")
    rows = packed.groupBy("doc_id").agg({"n_tokens": "sum", "n_segments": "sum", "n_loss": "sum"}).collect()
    found = {r["doc_id"]: (r["sum(n_tokens)"], r["sum(n_segments)"], r["sum(n_loss)"]) for r in rows}
    for doc, tokens, segments, loss in ITEMS:
        assert (found[doc][0], found[doc][2]) == (tokens or 0, loss or 0)
        assert found[doc][1] >= (segments or 0)
    for r in containers(packed).collect():
        assert r["used_tokens"] <= 10 and r["used_segments"] <= 8 and r["used_loss"] <= 4


def test_what_fits_no_container_is_an_error(spark):
    with pytest.raises(ValueError, match="exceeds"):
        dot_product_packing(np.array([[0, 100, 0]]), np.array([10, 8, 4]))
    with pytest.raises(ValueError, match="no capacity"):
        pack(spark.createDataFrame([(1, 1)], "doc_id long, n_tokens long"), spark.createDataFrame([(1, None)], "limit_id int, capacity_tokens int"))


def plain(sizes, limits):
    """The rule without shortcuts: of the items that fit, the one that points most nearly along the space that is left."""
    relative = sizes / limits
    weights = relative.sum(axis=0) / relative.sum()
    open_items, container, number, space = set(range(len(sizes))), {}, 0, limits.astype(float).copy()
    while open_items:
        fit = [i for i in open_items if (sizes[i] <= space).all()]
        if not fit:
            number, space = number + 1, limits.astype(float).copy()
            continue
        best = max(fit, key=lambda i: (round(float((relative[i] * weights) @ (space / limits)), 12), relative[i].sum()))
        container[i := best] = number
        space -= sizes[i]
        open_items.remove(i)
    return number + 1, container


@pytest.mark.parametrize("seed", range(4))
def test_three_different_limits_fill_as_the_plain_rule_does(seed):
    rng = np.random.default_rng(seed)
    sizes = np.stack([rng.integers(1, 60, 150), rng.integers(1, 9, 150), rng.integers(0, 30, 150)], axis=1)
    limits = np.array([100, 12, 50])
    found = dot_product_packing(sizes, limits)
    for c in range(found.max() + 1):
        assert (sizes[found == c].sum(axis=0) <= limits).all()
    assert found.max() + 1 <= plain(sizes, limits)[0] + 1


@pytest.mark.parametrize("seed", range(4))
def test_one_dimension_fills_nearly_all(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 400, 5000)
    both = dot_product_packing(np.stack([sizes, np.ones(5000, dtype=np.int64), sizes], axis=1), np.array([512, 2**62, 512]))
    used = np.bincount(both, weights=sizes)
    assert used.max() <= 512 and len(used) <= np.ceil(sizes.sum() / 512) + 2 and (used > 0).all()


def test_parts_are_as_large_as_the_limits_allow(spark):
    items = spark.createDataFrame([(1, 1000, 1, 100), (2, 1100, 1, 0)], "doc_id long, n_tokens long, seg long, loss long")
    limits = spark.createDataFrame([(1, 600, 8, 50)], "limit_id int, capacity_tokens int, max_segments int, max_loss int")
    rows = sorted((r.doc_id, r.part_no, r.n_tokens, r.n_loss) for r in pack(items, limits, segments="seg", loss="loss").collect())
    assert rows == [(1, 0, 500, 50), (1, 1, 500, 50), (2, 0, 600, 0), (2, 1, 500, 0)]


def test_the_result_does_not_depend_on_partitions_and_keeps_repeated_rows(spark):
    rows = [(i % 7 if i % 3 else 5, 40 + i % 5 if i % 3 else 9, "x") for i in range(600)]
    limits = spark.createDataFrame([(1, 100), (2, 64)], "limit_id int, capacity_tokens int")
    results = []
    for n in (1, 5):
        items = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string").repartition(n)
        packed = pack(items, limits, block_items=100)
        results.append(sorted(map(tuple, packed.drop("slot").collect())))
    assert results[0] == results[1] and len(results[0]) == 1200
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(empty, limits).collect() == [] and pack(items, limits.limit(0)).collect() == []
