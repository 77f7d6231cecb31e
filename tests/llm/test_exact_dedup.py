"""Exact deduplication against direct grouping."""

import hashlib
import re

import pytest
from area_trends.llm import exact_dedup as ed
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, recipe string, _row int, kept string"
CASES = [
    (5, "a b\tc", "x", 1, "y"),
    (3, "abc", None, 1, None),
    (9, "a  b \r\n c", "x", 2, "y"),
    (9, "a  b \r\n c", "x", 2, "y"),
    (None, "a  b \r\n c", "x", 2, "y"),
    (1, None, None, None, None),
    (2, "", "x", 3, "y"),
    (4, " \x0b\x0c ", "x", 3, "y"),
    (6, "a b\u0085c", "x", 3, "y"),
    (7, "ab\u0085c", "x", 3, "y"),
    (8, "中文 é" * 3000, "x", 3, "y"),
    (10, "中文é" * 3000, "x", 3, "y"),
    (11, "x" * 300_000, "x", 3, "y"),
    (12, "x" * 299_999, "x", 3, "y"),
]


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(cases):
    groups = {}
    for i, (doc_id, text) in enumerate(cases):
        groups.setdefault(bare(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    for norm, members in groups.items():
        first = min(members)
        for m in members:
            ids = [None if x[1] else x[2] for x in (m, first)]
            yield (*ids, len(members), m == first, hashlib.sha256(norm.encode()).hexdigest())


def key(row):
    return tuple(str(v) for v in row)


def test_edges(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    found = sorted((tuple(r) for r in ed.exact_dedup(docs).collect()), key=key)
    assert found == sorted(brute([c[:2] for c in CASES]), key=key)
    kept = ed.drop_copies(docs)
    assert kept.columns == docs.columns
    assert rows(kept.where("doc_id = 8"), *docs.columns) == [c for c in CASES if c[0] == 8]
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 6, 7, 8, 9, 11, 12]
    assert ed.exact_dedup(docs.limit(0)).count() == ed.drop_copies(docs.limit(0)).count() == 0


def test_narrow_identifiers_are_widened(spark, monkeypatch):
    """With identifiers of few values different chunks share one, until there are enough of them."""
    monkeypatch.setattr(
        ed, "identifier", lambda chunk, width: [F.pmod(F.xxhash64(F.lit(i), chunk), F.lit(4)) for i in range(width)]
    )
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(120)], "doc_id long, text string")
    assert ed.verified_width(docs, 1) > 3
    found = sorted((tuple(r) for r in ed.exact_dedup(docs, 1).collect()), key=key)
    assert found == sorted(brute([(i, f"text {i % 40}") for i in range(120)]), key=key)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\té中"), max_size=6), max_size=12))
def test_small_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((tuple(r) for r in ed.exact_dedup(docs).collect()), key=key)
    assert found == sorted(brute(list(enumerate(texts))), key=key)


def test_chunks_follow_content(spark, sf):
    """Chunks make up the text, keep their sizes, and are mostly those of a text with words put before it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 8000").select("text")
    cut = docs.select(
        ed.chunks(ed.normalised(F.col("text"))).alias("a"),
        ed.chunks(ed.normalised(F.concat(F.lit("put before "), "text"))).alias("b"),
        ed.normalised(F.col("text")).alias("text"),
    ).collect()
    assert cut
    for row in cut:
        assert "".join(row["a"]).encode("latin-1").decode() == row["text"]
        assert all(256 <= len(c) <= 4096 for c in row["a"][:-1]) and 0 < len(row["a"][-1]) <= 4096
        assert row["a"][-1] == row["b"][-1] or len(set(row["a"]) & set(row["b"])) > len(row["a"]) // 2


@pytest.mark.parametrize("text", ["", "x", "sea" * 5000, "\u0085\n" * 9000, "é" * 5000])
def test_any_text_is_made_up_of_its_chunks(spark, text):
    found = spark.createDataFrame([(text,)], "text string").select(ed.chunks(F.col("text")).alias("c")).first()["c"]
    assert "".join(found).encode("latin-1").decode() == text
    assert bool(found) == bool(text)


def test_texts_are_not_joined(spark, sf):
    """Only recipes reach the join: no text is shuffled but the chunks of the verification."""
    plan = ed.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "documents.parquet" not in plan
