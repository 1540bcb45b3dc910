"""Look-alike characters: composition against unicodedata, one form for all disguises, and odd tables."""

from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm.lookalikes import TO_LATIN, composed, from_arrow, is_unusual, ordinary, ordinary_list, to_arrow, unusual

ORDINARY = ["Café Noël", "Über Größe", "Старый причал", "O Sr. João", "第二版（注）：冬の港", "शक्ति का गीत", "كتاب البحر", "ระบบนำเข้า", "naïve – “quoted” … 1984", "A. B. O’Neill"]
MARKS = "aeoAEOnsuıäṇ़̨̧̃́̀̈̈́ͅकऩ각가ガÅ x"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=MARKS, max_size=12), max_size=6))
def test_marks_are_joined_as_unicode_says(texts):
    apart = [normalize("NFD", t) for t in texts]
    assert to_arrow(composed(from_arrow(pa.array(apart, pa.string())))).to_pylist() == [normalize("NFC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(max_size=10), max_size=6))
def test_code_points_and_back(texts):
    held = pa.array(texts, pa.string())
    assert to_arrow(from_arrow(held)).to_pylist() == [t or "" for t in texts]


def disguises(text):
    yield normalize("NFD", text)
    yield "​".join(text)
    yield text.replace(" ", " ")
    yield "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)
    back = {v: k for k, v in TO_LATIN.items() if "Ѐ" <= k <= "ӿ"}
    yield "".join(back.get(c, c) if i % 3 == 1 else c for i, c in enumerate(text))
    yield text.replace("fi", "ﬁ").replace("-", "‑")


def test_every_disguise_comes_to_one_form():
    for text in ("Winter Lighthouse", "O arquivo final", "pre-print of the sea"):
        for other in disguises(text):
            assert ordinary(other) == text
            assert is_unusual(other) == (other != text), other


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary_texts_stay(text):
    assert not is_unusual(text) and ordinary(text) == text


def test_texts_of_a_batch_do_not_touch_each_other():
    texts = ["a", "́b", None, "", "é", "Ж", "a", "‍"] * 40
    assert ordinary_list(texts) == [ordinary(t) for t in texts]


def test_odd_tables(spark):
    schema = "record_id long, title string, authors array<string>, field_name string, ordinary int"
    rows = [(1, "Ｔｈｅ", ["ok", "Wintеr", None], "x", 0), (1, "Ｔｈｅ", ["ok", "Wintеr", None], "x", 0), (2, None, None, "x", 0), (None, "", [], "x", 0), (3, "Café " * 20_000, [None], None, None), (4, "CafÃ©", ["x"], "", 1)]
    found = sorted((r.record_id, r.field_name, len(r.ordinary), (r.ordinary[1] if len(r.ordinary) > 1 else r.ordinary[0])[:6]) for r in unusual(spark.createDataFrame(rows, schema), "record_id", ("title", "authors")).collect())
    assert found == [(1, "authors", 3, "Winter"), (1, "authors", 3, "Winter"), (1, "title", 1, "The"), (1, "title", 1, "The"), (3, "title", 1, "Café C")]
    assert unusual(spark.createDataFrame([], schema), "record_id", ("title", "authors")).collect() == []
    assert np.array(from_arrow(pa.array([], pa.string())).points).size == 0
