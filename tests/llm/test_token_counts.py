import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm.token_counts import MergeTable, count_tokens, text_counter

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "a" * 3000, "ab" * 999, "\n\n \t x  ", "it's we'll 'T", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|>", "héé 𝒳 日本語 ñ", "1234567 $$$###", "\u0000  x"]


@pytest.fixture(scope="module")
def table():
    return MergeTable.read(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sizes(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(table, library):
    assert text_counter(table)(HARD).tolist() == sizes(library, HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=6))
def test_any_text(table, library, texts):
    assert text_counter(table)(texts).tolist() == sizes(library, texts)


def test_memory_of_words_is_bounded(table, library, monkeypatch):
    monkeypatch.setattr("foliant.llm.token_counts.REMEMBERED", 3)
    count = text_counter(table)
    for texts in (HARD, HARD[::-1]):
        assert count(texts).tolist() == sizes(library, texts)


def test_rows(spark, library):
    texts = [*HARD, None, "same", "same", "w " * 40_000]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "x y", 1)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in count_tokens(docs, PATH).collect()}
    want = sizes(library, [t or "" for t in texts])
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert [got[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [got[i]["over_limit"] for i in range(len(texts))] == [n > 512 for n in want]
    assert got[None]["n_tokens"] == 2


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
