"""Sentence boundaries: cases by language, time, and what holds of every division."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm.sentences import sentence_spans, sentences

TWO = [
    "He told me. Then he left.", "She gave it to me. We went home.", "The answer is no. I left.", "They make art. A museum opened.", "He opened the app. A menu came up.",
    "The sun set. 3 birds sang.", "Yes, you may. 5 people came.", "He is my hon. The end.", "He went at 5 p.m. Then he slept.", "I am 12. He is 14.", "She said no. I left.", "It was 5 p.m. The door opened.",
    "Er kam am 3. März nach Hause. Dann ging er.", "Siehe S. 5 und Abb. 3 im Text. Danach kam nichts mehr.", "Voir p. 12 et fig. 3 du texte. M. Dupont est venu.", "Veja a pág. 12 do texto. O Sr. Silva não veio.",
    "Véase la pág. 12 del texto. El Sr. Gómez no vino.", "См. стр. 12 и рис. 3 в тексте. Потом пришёл проф. Иванов.", "See p. 12 and Fig. 3 of the text. Dr. Smith came.", "Nº 5 está aqui, veja a pág. 3 do texto. Depois não.",
    "第一章。第二章！", "He said “Go. Now. Please.” to us. We went.", "यह पहला है। यह दूसरा है।",
]


@pytest.mark.parametrize("text", TWO)
def test_two_sentences(text):
    assert len(sentence_spans(text)) == 2, [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize("text", ["Am 3. Oktober kam er.", "Le 3 mai, M. Dupont a lu la p. 5.", "A. B. Smith wrote it.", "1. Introduction", "It costs 3.50 e.g. here", "The No. 5 bus", "351 . 161"])
def test_one_unit(text):
    assert len(sentence_spans(text)) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\r\t“”»«()\"'’1日。กข अ।é́ ", max_size=60))
def test_units_cover_everything_but_white_space(text):
    spans = sentence_spans(text)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    held = {i for a, b in spans for i in range(a, b)}
    assert all(i in held for i, c in enumerate(text) if not c.isspace())


@pytest.mark.parametrize("text", ["1. " * 60_000 + "a", "a" + "(" * 60_000 + "”" * 60_000, "Dr. " * 60_000 + "a", "“" * 60_000 + ". b" * 1000, "e.g. " * 50_000, ". " * 60_000 + "a", "No. " * 60_000, "…" * 100_000 + " a"])
def test_time_is_linear(text):
    began = time.time()
    sentence_spans(text)
    assert time.time() - began < 5


def test_odd_tables(spark):
    rows = [(1, "A b. C d.", 1, "x"), (1, "A b. C d.", 1, "x"), (2, None, 0, ""), (3, "", 0, ""), (4, " \n\n ", 0, ""), (None, "x", 0, ""), (5, "y " * 50_000, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sent_no int, start_char string")
    found = sorted((str(r.doc_id), r.sent_no, r.start_char, r.end_char) for r in sentences(df).collect())
    assert found == [("1", 0, 0, 4), ("1", 0, 0, 4), ("1", 1, 5, 9), ("1", 1, 5, 9), ("5", 0, 0, 99_999), ("None", 0, 0, 1)]
    assert sentences(df.limit(0)).collect() == []
