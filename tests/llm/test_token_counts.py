"""Token counts against the tokenizers library."""

import public_tokenizers
import pytest
from area_trends.llm import bpe, queries
from area_trends.llm.token_counts import Counter, token_counts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = Counter(PATH)


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ",
        "  a  b \n\n c\t d ",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50,
        "x<|endoftext|>y <|endoftext|><|endoftext|> z<|endoftext",
        "it's we'll I'd 'sabc ''s",
        "Éa 　b\x85c\x1cd ​ é \U0001f600\U0001f468‍\U0001f469 ½ Ⅷ ٣",
        "word\n \nword \n word  \n  word\r\n",
        "the quick " * 4000,
    ],
)
def test_cases(text):
    assert COUNTER.count([text]) == [expected(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abth e\n\t '1.é漢😀 ")), max_size=60), max_size=4))
def test_any_text(values):
    assert COUNTER.count(values) == [expected(v) for v in values]


def test_rounds_equal_single_merges():
    merges = bpe.Merges(PATH)
    words = ["banana", "aaaaa", "mississippi", "x", "éé"]
    assert bpe.count_symbols(words, merges).tolist() == [expected(w) for w in words]


def test_small_store_gives_the_same_counts():
    small = Counter(PATH, max_cached=3)
    values = ["a b c d e", "f g h", "a b c"]
    assert [small.count([v])[0] for v in values] == [expected(v) for v in values]


def test_rows(spark):
    rows = [(1, None, 7, "x"), (2, "", 7, "x"), (3, "a b", 7, "x"), (3, "a b", 7, "x"), (None, "c", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    found = token_counts(docs, PATH, limit=1)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, True), (3, 3, 2, True), (None, 1, 1, False)], key=str
    )
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_query(spark, sf):
    found = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    docs = queries.documents(spark, sf).collect()
    assert len(found) == len(docs)
    for row in docs:
        text = row.text or ""
        n = expected(text)
        assert found[row.doc_id] == (row.doc_id, len(text.encode()), n, n > 512)
