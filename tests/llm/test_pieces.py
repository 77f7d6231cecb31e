"""Encoding and decoding against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from area_trends.llm import queries
from area_trends.llm.pieces import Encoder, coding, piece_digests, piece_ids
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ENCODER = Encoder(PATH)


def expected(text):
    return LIBRARY.encode(text, add_bos=True, add_eos=True)


def found(text):
    return np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "  ", " a", "a ", "a  b   c" + " " * 40 + "d", "▁▁ x▁y", "tab\tline\n\nend\x00", "é\U0001f600漢字ñ½Ａﬁ",
        "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization" * 30, "x" * 3000,
        "====----====", "0000000000000000", "The quick brown fox. " * 50,
    ],
)
def test_cases(text):
    assert found(text) == expected(text)
    assert ENCODER.decode(found(text)) == LIBRARY.decode(expected(text))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinorsth  =-\n▁é漢😀")), max_size=80))
def test_any_text(text):
    assert found(text) == expected(text)
    assert ENCODER.decode(found(text)) == LIBRARY.decode(expected(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=30))
def test_decode_any_ids(ids):
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids), r.decoded) for r in piece_ids(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted([(i, expected(t or ""), t or "") for i, t, _ in rows], key=str)
    assert piece_digests(docs.limit(0), PATH).count() == 0


def test_query(spark, sf):
    got = {r.doc_id: r for r in queries.op10_piece_coding(spark, sf).collect()}
    docs = queries.documents(spark, sf).collect()
    assert len(got) == len(docs)
    for row in docs:
        ids = expected(row.text or "")
        decoded = LIBRARY.decode(ids)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[row.doc_id] == (row.doc_id, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest())


def test_runs_are_searched_once(monkeypatch):
    asked = []
    tokens = Encoder.tokens
    monkeypatch.setattr(Encoder, "tokens", lambda self, text: asked.append(text) or tokens(self, text))
    text = "zebra, zebra. zebra\nzebra (zebra) zebra"
    encoder = Encoder(PATH)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == expected(text)
    assert len(asked) == len(set(asked)) and asked.count("▁zebra") == 1
    assert not any(c in t for t in asked for c in "\n" if len(t) > 1)


def test_stores_are_bounded():
    encoder = Encoder(PATH, max_cached=50)
    for i in range(300):
        text = f"w{i * 7919}x, q{i}r. {i}\n(zebra{i})"
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == expected(text)
    assert max(map(len, (encoder.known, encoder.inner, encoder.together))) <= 50


def test_a_task_codes_little_at_a_time():
    rows = [(i, "zebra " * 50_000) for i in range(10)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    parts = list(coding(PATH, 100, True)(iter([batch])))
    assert max(sum(map(len, p.column("decoded").to_pylist())) for p in parts) <= 1_000_000
    assert [(r["doc_id"], r["decoded"]) for p in parts for r in p.to_pylist()] == rows
