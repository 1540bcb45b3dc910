"""Token ids against a plain encoding of each text for itself."""

import pyarrow as pa
import pytest
import regex

from quirespark.llm import tokens

VOCABULARY = [bytes([i]) for i in range(256)] + [b"ab", b" ab", b"abc"]


@pytest.fixture(scope="module")
def lexicon(tmp_path_factory):
    path = tmp_path_factory.mktemp("lexicon") / "lexicon.bin"
    path.write_bytes(tokens.pack_lexicon(["ab", " ab", "one"], VOCABULARY))
    return tokens.Lexicon.open(str(path))


def plain(text):
    ranks = {t: i for i, t in enumerate(VOCABULARY)}
    return [i for word in regex.findall(tokens.WORD_PATTERN, text or "") for i in tokens.merge(word.encode(), ranks)]


def cut_by_row(texts, lexicon):
    ids, lengths = tokens.encode_texts(texts, lexicon)
    ends = [0, *lengths.cumsum().tolist()]
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_ids_around_a_long_text_stay_with_their_rows(lexicon):
    long = "abc ab " * (tokens.CHUNK_CHARS // 7 + 1)
    assert len(long) > tokens.CHUNK_CHARS
    texts = ["one ab", None, long, "", "ab two", long, "three"]
    assert cut_by_row(texts, lexicon) == [plain(t) for t in texts]


def test_a_long_text_longer_than_a_chunk_of_words(lexicon, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 10)
    monkeypatch.setattr(tokens, "CHUNK_WORDS", 2)
    texts = ["ab", "one", "ab one ab two ab", "x", "abcabcabc y z ab", "ab"]
    assert cut_by_row(texts, lexicon) == [plain(t) for t in texts]
    chunks = list(tokens.word_chunks(texts, tokens.WORD_PATTERN))
    assert [i for _, parts in chunks for i, _ in parts] == sorted(i for _, parts in chunks for i, _ in parts)
    assert all(isinstance(w, pa.Array) for w, _ in chunks)
