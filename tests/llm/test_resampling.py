"""Importance resampling against direct counting."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from area_trends.llm import resampling as rs
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, runs string, rank int, n_words string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, items, percent=5, least=20, buckets=10_000):
    s = Counter(crc32(f.encode()) % buckets for _, text in docs for f in runs(text))
    t = Counter(crc32(f.encode()) % buckets for _, text in items for f in runs(text))
    all_s, all_t = s.total(), t.total()
    found = []
    for i, (doc_id, text) in enumerate(docs):
        held = [crc32(f.encode()) % buckets for f in runs(text)]
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in held
        )
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([doc_id, len(words(text)), len(held), weight, score, None, i])
    enough = sorted((r for r in found if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(enough[: percent * len(enough) // 100], 1):
        row[5] = rank
    return [tuple(r[:6]) for r in found]


def table(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((v is None, v) for v in r))


LONG = "Straße 12, l'été 中文 " * 400
CASES = [
    (1, None, "x", 1, "y"),
    (2, "", None, None, None),
    (3, " .,; \x7f\x00", "x", 1, "y"),
    (4, "One two", "x", 1, "y"),
    (5, LONG, "x", 1, "y"),
    (5, LONG, "x", 1, "y"),
    (6, LONG, "x", 1, "y"),
    (None, LONG, "x", 1, "y"),
    (7, "w" * 5000 + " " + "é" * 3000, "x", 1, "y"),
    *[(i, " ".join(f"w{i * j % 17}" for j in range(30)), "x", 1, "y") for i in range(10, 60)],
]
ITEMS = [(1, "one TWO w1 w2 w3"), (1, None), (2, "l'été"), (None, "w4 w5 w6 w7")]


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(rs, "PART_BYTES", 50)
    docs = spark.createDataFrame(CASES, SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = rs.resample(docs, items, percent=30)
    plain = [c[:2] for c in CASES]
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert table(found.collect()) == table(brute(plain, ITEMS, 30))
    drawn = rs.drawn_documents(docs, items, percent=30)
    assert drawn.columns == docs.columns
    ids = {r[0] for r in brute(plain, ITEMS, 30) if r[5]}
    assert len(ids) > 5 and rows(drawn, "doc_id", "text") == sorted(
        [c for c in plain if c[0] in ids], key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    assert rs.resample(docs.limit(0), items).count() == 0
    assert table(rs.resample(docs, items.limit(0), percent=30).collect()) == table(brute(plain, [], 30))


@pytest.mark.parametrize("part", [1, 7, 10_000])
@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aB1é中 ,.\x00\x7f"), max_size=60))
def test_runs(part, text):
    before, rs.PART_BYTES = rs.PART_BYTES, part
    try:
        parts = list(rs.run_codes(text, rs.splitter()))
    finally:
        rs.PART_BYTES = before
    assert sum(n for n, _ in parts) == len(words(text))
    assert sorted(np.concatenate([np.zeros(0), *[c for _, c in parts]])) == sorted(crc32(f.encode()) for f in runs(text))


def test_positions(spark):
    from area_trends.llm.common import number_rows
    from pyspark.sql import functions as F

    df = spark.range(10_000).select("id", (F.col("id") % 7).alias("k"))
    found = number_rows(df.repartition(5), F.desc("k"), F.col("id"))
    expected = sorted(((i, i % 7) for i in range(10_000)), key=lambda r: (-r[1], r[0]))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[2]) == [(*r, n) for n, r in enumerate(expected, 1)]
