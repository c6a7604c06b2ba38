import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import collected, documents, odd_rows
from spanveil.llm.queries import op1_token_counts, table
from spanveil.llm.token_counts import TokenCounter, token_counts, unproved, whole_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter(library):
    definition = open(PATH, encoding="utf-8").read()
    pattern = public_tokenizers.PATTERN
    return TokenCounter(definition, pattern, whole_tokens(library), unproved(definition, pattern))


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_table_as_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for r in op1_token_counts(spark, sf_dir).collect():
        n = expected(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 1024)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(counter, library, text):
    assert counter.count(text) == expected(library, text)


@pytest.mark.parametrize("text", [
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't I'LL we're 's", "  \n\n  x\t\ty ", "12³½ ٣",
    "\U0001F9D1‍\U0001F680 ok", "\U0002A6D6 abc", "͸߾ new", "a" * 50_000, "\x1c\x85᠎ z",
])
def test_odd_texts(counter, library, text):
    assert counter.count(text) == expected(library, text)


def test_odd_rows(spark, library):
    rows = odd_rows()
    got = collected(token_counts(documents(spark, rows, clashing=True), PATH, public_tokenizers.PATTERN),
                    "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(((r[0], len((r[1] or "").encode()), expected(library, r[1])) for r in rows), key=repr)
    empty = token_counts(documents(spark, []), PATH, public_tokenizers.PATTERN)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0
