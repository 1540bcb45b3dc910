"""Languages of texts: accuracy on sentences of each, spans against all runs of states, and odd tables."""

from itertools import product

import numpy as np
import pytest

from quirespark.llm import languages
from quirespark.llm.languages import detected, label_names, language_spans, mislabelled, text_languages, unnamed

SENTENCES = {
    "en": ["The archive keeps both copies of the book.", "Nothing was lost after the second import."], "pt": ["O arquivo guarda as duas cópias do livro.", "Nada foi perdido depois da segunda importação."],
    "es": ["El archivo guarda las dos copias del libro.", "No se perdió nada después de la segunda importación."], "fr": ["L'archive garde les deux copies du livre.", "Rien n'a été perdu après la seconde importation."],
    "de": ["Das Archiv behält beide Kopien des Buches.", "Nach dem zweiten Import ging nichts verloren."], "ru": ["Архив хранит обе копии книги."], "ar": ["يحفظ الأرشيف نسختي الكتاب."], "hi": ["संग्रह दोनों प्रतियाँ रखता है।"],
    "th": ["คลังเก็บสำเนาทั้งสองไว้"], "zh": ["档案库保存了这本书的两个副本。"], "ja": ["書庫は本の二つの写しを保つ。"],
}
NAMES = label_names([(x, x, x, x) for x in SENTENCES])


@pytest.mark.parametrize("lang", SENTENCES)
def test_each_language_and_all_pairs(lang):
    for sentence in SENTENCES[lang]:
        assert text_languages(sentence) == [lang]
    for other in SENTENCES:
        if other != lang:
            text = f"{SENTENCES[lang][0]} {SENTENCES[other][0]} {SENTENCES[lang][-1]}"
            assert text_languages(text) == sorted({lang, other}), text


def test_spans_tell_where_each_language_is():
    text = SENTENCES["en"][0] + " " + SENTENCES["fr"][1] + "\n\n" + SENTENCES["zh"][0]
    spans = language_spans(text)
    assert [(text[a:b], lang) for a, b, lang, _, _ in spans] == [(SENTENCES["en"][0], "en"), (SENTENCES["fr"][1], "fr"), (SENTENCES["zh"][0], "zh")]
    assert all(0 < sure <= 1 for *_, sure, _ in spans)


def test_a_change_within_a_stretch():
    text = "the archive of the books was not in the house and they have it de la maison qui est dans les rues et avec sans pour une des"
    assert [x[2] for x in language_spans(text)] == ["en", "fr"]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_of_all_runs(seed):
    rng = np.random.default_rng(seed)
    rows, costs = rng.random((6, 3)).round(3).tolist(), [0.7, 0.7, 4.0, 0.7, 4.0, 0.7]

    def worth(states):
        return sum(r[s] for r, s in zip(rows, states)) - sum(c for c, a, b in zip(costs[1:], states, states[1:]) if a != b)

    assert abs(worth(languages._viterbi(rows, costs)) - max(worth(x) for x in product(range(3), repeat=6))) < 1e-9


def test_labels(spark):
    schema = "doc_id long, text string, lang string, langs array<string>, tab_name string"
    rows = [(1, SENTENCES["en"][0], "pt", None, "x"), (2, SENTENCES["en"][0], "en", None, "x"), (3, SENTENCES["en"][0], None, None, "x"), (4, None, "en", None, "x"), (5, "", None, None, "x"), (6, "351 — 12", None, None, "x"), (None, SENTENCES["de"][0], "", None, "x"), (7, SENTENCES["fr"][0] * 3000, "fr", None, "x")]
    df = spark.createDataFrame(rows, schema)
    found = detected(df, "doc_id", "text", ("lang",))
    wrong = sorted(str(tuple(r)) for r in mislabelled(found, "doc_id", "lang", NAMES, "documents").collect())
    assert wrong == ["('documents', '1', 'en')", "('documents', '3', 'en')", "('documents', None, 'de')"]
    catalog = spark.createDataFrame([(1, ["en"]), (2, None), (3, ["en", None, "xx"])], "doc_id long, languages array<string>")
    assert [tuple(r) for r in unnamed(found, catalog, "doc_id", "languages", NAMES, "corpus_catalog").collect()] == [("corpus_catalog", 2, "en")]
    assert mislabelled(detected(df.limit(0), "doc_id", "text", ("lang",)), "doc_id", "lang", NAMES, "t").collect() == []
