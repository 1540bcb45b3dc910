"""Garbled texts: every pair of encodings on sentences of the languages, mixed texts, and odd tables."""

import pytest

from quirespark.llm.garbled import DOUBLE, SINGLE, garbled, garbled_spans, is_garbled, repaired

SENTENCES = {
    "pt": "A organizadora não encontra a informação na edição.", "es": "El índice añade un prólogo señalado.", "fr": "La responsable relie déjà chaque référence à l’édition.",
    "de": "Über die größten Änderungen für müde Leser.", "ru": "Переводчик хранит рисунок рядом с абзацем", "ar": "فهرس الكتاب يقارن بين نسختي المنشور", "hi": "संशोधित मुद्रण में पढ़ने का साधन",
    "th": "ผู้แปลเก็บภาพไว้ข้างย่อหน้า", "zh": "第二版描写了冬天的港口小镇。", "ja": "書庫は図を段落のとなりに置く。",
}


@pytest.mark.parametrize("lang", SENTENCES)
def test_ordinary_text_is_left_alone(lang):
    for text in (SENTENCES[lang], SENTENCES[lang].upper(), f"“{SENTENCES[lang]}” — «ok» …", f"x: {SENTENCES[lang]}\u00a0(1)"):
        assert not is_garbled(text) and repaired(text) == text


@pytest.mark.parametrize("encoding", [*SINGLE, *DOUBLE])
def test_utf8_by_each_encoding_is_found(encoding):
    found = []
    for lang, text in SENTENCES.items():
        try:
            wrong = text.encode().decode(encoding)
        except UnicodeDecodeError:
            continue
        found.append((is_garbled(wrong), repaired(wrong) == text, lang))
    assert all(x[0] for x in found), found
    if encoding in SINGLE:
        assert sum(x[1] for x in found) >= 0.8 * len(found), found


@pytest.mark.parametrize("lang, true, wrong", [("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ru", "cp1251", "latin-1"), ("ru", "cp866", "cp1252"), ("ar", "cp1256", "latin-1"), ("th", "cp874", "latin-1"), ("zh", "gbk", "latin-1"), ("ja", "euc_jp", "latin-1"), ("ja", "cp932", "latin-1")])
def test_legacy_encodings_by_others(lang, true, wrong):
    try:
        seen = SENTENCES[lang].encode(true).decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("this encoding can't read it")
    assert is_garbled(seen) and repaired(seen) == SENTENCES[lang]


def test_only_matched_stretches_are_replaced():
    right, wrong = "Große Flüsse – “déjà” ", "Chão é".encode().decode("cp1252")
    assert repaired(right + wrong + " naïve") == right + "Chão é naïve"
    assert [(right + wrong)[s.start : s.end] for s in garbled_spans(right + wrong)] == ["Ã£", "Ã©"]
    twice = "Não à Île".encode().decode("cp1252").encode().decode("cp1252")
    assert repaired(twice) == "Não à Île"
    assert repaired("Cole\ufffd\ufffdo") is None and is_garbled("Cole??o")


def test_odd_tables(spark):
    schema = "record_id long, title string, description string, field_name string, repaired int"
    rows = [(1, "CafÃ©", None, "x", 1), (1, "CafÃ©", "", "x", 1), (None, "ok", "Ã© " * 30_000, "x", 1), (2, None, None, None, None), (3, " ", "é " * 50_000, "", 0)]
    found = sorted((str(r[0]), r[1], r[2][:4]) for r in garbled(spark.createDataFrame(rows, schema)).collect())
    assert found == [("1", "title", "Café"), ("1", "title", "Café"), ("None", "description", "é é ")]
    assert garbled(spark.createDataFrame([], schema)).collect() == []
