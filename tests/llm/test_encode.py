"""Token ids of a table against the public library, and odd tables."""

import base64

import pytest

from quirespark.llm.tokens import encode, token_counts, vocabulary_path

TEXTS = ["The cat's café — 123 000!", None, "", " ", "\n\n  x\t", "<|endoftext|>", "第二版（注）", "ที่ระบบ", "é" * 50, "A" * 5000, "The cat's café — 123 000!", "it's We'll 'S ok", "🙂🙂 x"]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "y")], "doc_id long, text string, ids string")
    found = encode(df).collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        assert list(r.ids) == library.encode_ordinary(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]
    counts = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert counts == {i: len(library.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}


def test_the_bound_on_compiled_words_changes_no_ids(spark, library, monkeypatch):
    monkeypatch.setattr("quirespark.llm.tokens.LEXICON_WORDS", 2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in encode(df).collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
