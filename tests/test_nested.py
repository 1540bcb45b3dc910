"""Nested records: the tape against a plain decoder, hostile payloads, and the child tables."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.operators.jsontape import Forest
from quirespark.operators.nested import REPORT_SHAPE, canonical_name, child_table, decode, report_items

REPORT = {
    "publications": [
        {
            "id": "p",
            "evidence": {"semantic": {"ordered_node_ids": ["a", None, {"Id": "b"}], "OrderedChapterIds": "c"}},
            "PackageProcessing": {"spine": [{"position": 3, "fallbackChain": ["x", "y"]}, {"position": 7, "fallback_chain": []}]},
        }
    ]
}
WANT = [("chapter", -1, 0, "c"), ("fallback", 3, 0, "x"), ("fallback", 3, 1, "y"), ("node", -1, 0, "a"), ("node", -1, 2, "b")]
JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=6), inner, max_size=4),
    max_leaves=20,
)


def items(spark, payloads):
    rows = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string")
    out = {}
    for r in report_items(rows).collect():
        out.setdefault(r.record_id, []).append((r.list_name, r.parent_pos, r.item_ord, r.item_id))
    return {k: sorted(v) for k, v in out.items()}


def value_of(forest, at):
    """A value of the tape as Python sees it, to hold it against json.loads."""
    tape = forest.tape
    kind = tape.kind[at]
    if kind in (1, 3):
        children, _ = forest.children(pa.array([at]).to_numpy())
        if kind == 3:
            return [value_of(forest, c) for c in children]
        return {tape.names[tape.name[c]]: value_of(forest, c) for c in children}
    text = tape.text(pa.array([at]).to_numpy()).to_pylist()[0]
    return text if kind == 7 else json.loads(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=4), st.booleans())
def test_the_tape_says_what_a_plain_decoder_says(values, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only) for v in values]
    forest = Forest(pa.array(texts), lambda x: x)
    for root, value in zip(forest.tape.root, values, strict=True):
        assert value_of(forest, root) == value


@settings(max_examples=150, deadline=None)
@given(JSON, st.data())
def test_a_text_that_breaks_off_has_no_root(value, data):
    text = json.dumps({"k": value})
    cut = data.draw(st.integers(0, len(text) - 1))
    forest = Forest(pa.array([text[:cut], text]), lambda x: x)
    assert forest.tape.root[0] == -1 and forest.tape.root[1] >= 0


def test_wrapping_in_text_and_outer_objects_of_any_depth(spark):
    deep = REPORT
    for i in range(30):
        deep = {"note": {"n": i}, f"level_{i}": deep}
    wrapped = [
        json.dumps(REPORT), json.dumps(json.dumps(json.dumps(REPORT))), json.dumps(deep), json.dumps({"meta": {"x": 1}, "data": {"result": json.dumps(REPORT)}}),
        "﻿ " + json.dumps(REPORT), json.dumps({"PUBLICATIONS": json.dumps(REPORT["publications"])}), json.dumps({"publications": REPORT["publications"][0]}),
    ]
    found = items(spark, wrapped + wrapped)
    assert sorted(found) == list(range(14)) and all(v == WANT for v in found.values())


def test_hostile_payloads_give_nothing_and_harm_no_other(spark):
    bad = [None, "", " ", "{", json.dumps(REPORT)[:-2], "[" * 50_000, "]" * 9, '{"publications":[,]}', '{"a" "b"}', json.dumps(REPORT) + " x", '{"publications": "' + "[" * 50_000 + '"}', '{"publications":[{"id":01}]}']
    assert items(spark, [*bad, json.dumps(REPORT)]) == {len(bad): WANT}


def test_positions_and_identifiers_that_do_not_fit(spark):
    def payload(position, item):
        return json.dumps({"publications": [{"packageProcessing": {"spine": [{"fallbackChain": []}, {"position": position, "fallbackChain": [item]}]}}]})

    found = items(spark, [payload(10**30, "a"), payload("3.0", "b"), payload(2**31 + 5, "c"), payload(None, {"itemId": "d"}), payload(-4, "\ud800é"), payload(2, 12)])
    assert [v[0][1:] for _, v in sorted(found.items())] == [(1, 0, "a"), (3, 0, "b"), (1, 0, "c"), (1, 0, "d"), (-4, 0, "�é"), (2, 0, "12")]


def test_child_tables_keep_keys_and_places(spark):
    rows = spark.createDataFrame([(5, json.dumps(REPORT), "clash"), (6, None, "x")], "record_id long, payload string, publications_ord string")
    out = child_table(rows, ["record_id"], "payload", REPORT_SHAPE, "publications.packageprocessing.spine")
    got = [(r["record_id"], r["publications_ord"], r["publications_id"], r["publications_packageprocessing_spine_ord"], r["publications_packageprocessing_spine_position"]) for r in out.collect()]
    assert sorted(got) == [(5, 0, "p", 0, 3), (5, 0, "p", 1, 7)]
    assert child_table(rows.limit(0), ["record_id"], "payload", REPORT_SHAPE, "publications").collect() == []
    with pytest.raises(ValueError):
        child_table(rows, ["record_id"], "payload", REPORT_SHAPE, "publications.none")


def test_a_block_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr("quirespark.operators.nested.CHUNK_BYTES", 10)
    assert decode(pa.array([json.dumps(REPORT), None]), REPORT_SHAPE).to_pylist()[1] is None
    assert items(spark, [json.dumps(REPORT)] * 5) == {i: WANT for i in range(5)}
    assert canonical_name("Ordered_Node_IDs") == "orderednodeids"
