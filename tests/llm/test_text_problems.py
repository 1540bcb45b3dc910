"""Garbled texts, name variants, languages and look-alike characters, each on cases whose answer is known."""

import pytest

import __spark_entry__
from quirespark.llm.garbled import is_garbled, repaired
from quirespark.llm.languages import label_language, label_names, text_languages
from quirespark.llm.lookalikes import is_unusual, ordinary
from quirespark.llm.names import alike, variants

RIGHT = ["Canção em Dozal", "Füße über Größe", "Старый причал", "La Fenêtre de Noël", "A reader’s guide – “one”"]




def test_the_queries_are_registered():
    assert {"p3_found", "p4_found", "p5_found", "p6_found"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("encoding", ["latin-1", "cp1251", "cp437", "mac_roman", "cp850"])
@pytest.mark.parametrize("text", RIGHT)
def test_utf8_read_by_another_encoding(text, encoding):
    try:
        wrong = text.encode().decode(encoding)
    except UnicodeDecodeError:
        pytest.skip("this encoding can't read it")
    assert is_garbled(wrong) and repaired(wrong) == text


def test_other_wrong_readings_and_ordinary_texts():
    for text in ("古い書庫".encode("euc_jp").decode("latin-1"), "Старый причал".encode("koi8-r").decode("cp1251"), "关于小岛的笔记".encode().decode("gb18030", "replace"), "Cole��o", "Cole??o"):
        assert is_garbled(text), text
    for text in (None, "", *RIGHT, "MANHÃ EM CHÃO", "Price: £54, naïve", "† ‡", "Áb ÁÂÃÄÅ: ÇÃO", "“MANHÔ", "Who? me", "关于小岛的笔记", "ガラスの川", "мир ДОМ"):
        assert not is_garbled(text), text


def test_spellings_of_names():
    for a, b in (("Antônio Falk Pogo", "Pogo, Antônio"), ("Katharina Prado Brune", "Brune, Kathi (org.)"), ("F.F. Bitra", "Fernando Falk Bitra"), ("U. of Meliku", "University of Meliku"), ("Edward Vutupuja", "Edwаrd Vtuupuja"), ("Tahuto Beatriz", "Beatriz Moreno Tahuto"), ("Ducequagu (Verlag)", "Verlag Ducequagu & Co.")):
        assert alike(a, b) >= 0.5, (a, b)
    for a, b in (("Katharina Brune", "Elizabeth Brune"), ("Walter Amara", "Walter Bosevade"), ("Editora Rumabisu", "Instituto Rumabisu de Letras"), ("Fundação de Marés, A", "FUNDAÇÃO DE MARÉS, A"), ("A. Falk Brune", "A. Luz Brune")):
        assert alike(a, b) == 0, (a, b)


def test_pairs_of_names(spark):
    authors = spark.createDataFrame([("Pogo, Antônio",), ("Antônio Pogo",), ("Antônio Pogo",), (None,), ("Walter Pogo",)], "n string")
    headings = spark.createDataFrame([("Toninho Pogo",), ("Ilusão, A",), ("ILUSÃO, A",)], "n string")
    found = sorted(map(tuple, variants(authors, headings).collect()))
    assert found == [("Antônio Pogo", "Pogo, Antônio"), ("Antônio Pogo", "Toninho Pogo"), ("Pogo, Antônio", "Toninho Pogo")]
    assert variants(authors.limit(0), headings.limit(0)).collect() == []


def test_languages_of_texts_and_labels():
    assert text_languages("O tradutor guarda a figura. पृष्ठ 440 पर छोटा प्रकाशक वही शीर्षक दोहराता है।") == ["hi", "pt"]
    assert text_languages("A coleção liga cada nota à referência. Voir la remarque de la page. O arquivo não perde as legendas.") == ["fr", "pt"]
    assert text_languages("The archive keeps «Тихая типография» and cover.84.png in order.") == ["en"]
    assert text_languages("第二版描写了冬天的港口小镇。") == ["zh"] and text_languages("書庫は図を段落のとなりに置く。") == ["ja"]
    assert text_languages(None) == text_languages("351 161 — .") == []
    names = label_names([("pt", "por", "Portuguese", "português"), ("zh", "zho", "Chinese", "中文")])
    assert [label_language(x, names) for x in ("PT_br", " por", "Português", "zh-Hans", "chi", "und", None, "it")] == ["pt", "pt", "pt", "zh", "zh", None, None, None]


def test_unusual_characters():
    for text, right in (("Café", "Café"), ("Ｔｈｅ　ｓｅａ", "The sea"), ("Wintеr", "Winter"), ("S­ao", "Sao"), ("pre‑print", "pre-print"), ("A b", "A b"), ("⽉", "月"), ("у мopя", "у моря"), ("ﾉｰﾄ", "ノート")):
        assert is_unusual(text) and ordinary(text) == right, text
    for text in (None, "", "Café", "“Noël”  en Été", "Lições: Старый причал", "शक्‍ति", "目録：「（注）」", "п. 4"):
        assert not is_unusual(text), text
