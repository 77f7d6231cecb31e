"""Ranked search against scoring every document directly."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from area_trends.llm import lexical_search as ls
from area_trends.llm.lexical_index import SPACE, Shard, build, from_bytes, to_bytes
from area_trends.sources.tables import scratch_paths
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, rank int, _item string"


def words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, best=10):
    held = [(doc_id, Counter(words(text))) for doc_id, text in docs]
    held = [(doc_id, c) for doc_id, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        asked = Counter(words(text))
        scores = []
        for doc_id, c in held:
            m = 100 - 75 + 75 * c.total() * n // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in asked.items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:best], 1):
            yield item, rank, doc_id, -score


def table(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((v is None, v) for v in r))


CASES = [
    (1, None, "x", 1, "y"),
    (2, "", None, None, None),
    (3, "., \x7f", "x", 1, "y"),
    (4, "One two TWO zwei", "x", 1, "y"),
    (4, "One two TWO zwei", "x", 1, "y"),
    (None, "one two two ZWEI", "x", 1, "y"),
    (8, "one " * 70_000 + "É é 中文 " * 300, "x", 1, "y"),
    *[(i, " ".join(f"w{i * j % 23}" for j in range(i % 40)), "x", 1, "y") for i in range(10, 400)],
]
ITEMS = [(1, "one TWO"), (1, "two"), (2, None), (3, "w1 w2 w2 w3 é"), (4, "nowhere"), (None, "w5"), (5, "..."), (6, "one w0")]


@pytest.mark.parametrize(("shard", "block"), [(8_000_000, 500_000), (300, 3), (1, 1)])
def test_edges(spark, shard, block):
    docs = spark.createDataFrame(CASES, SCHEMA).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = ls.lexical_search(docs, items, shard_bytes=shard, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert table(found.collect()) == table(brute([c[:2] for c in CASES], ITEMS))
    assert ls.lexical_search(docs.limit(0), items).count() == ls.lexical_search(docs, items.limit(0)).count() == 0


def test_text_ids_and_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"w{i % 3} x") for i in range(30)], "doc_id string, text string")
    ls.build_index(docs).write.parquet(str(tmp_path / "index"))
    items = spark.createDataFrame([("a", "w1 x"), ("b", "w2")], "item_id string, text string")
    found = ls.search(spark.read.parquet(str(tmp_path / "index")), items, best=3)
    expected = brute([(f"d{i}", f"w{i % 3} x") for i in range(30)], [("a", "w1 x"), ("b", "w2")], 30)
    order = sorted(expected, key=lambda r: (r[0], -r[3], r[2]))
    firsts = [r for item in "ab" for r in [x for x in order if x[0] == item][:3]]
    assert [(r[0], r[2], r[3]) for r in table(found.collect())] == [(r[0], r[2], r[3]) for r in firsts]


VARIED = [(i, " ".join(f"w{(i * 31 + j * 7) % 5_000}" for j in range(40))) for i in range(1_500)]


def test_only_values_per_document_are_arrays(spark):
    """What a shard has per term, block or posting passes through the JVM as bytes, not element by element."""
    docs = spark.createDataFrame(VARIED, "doc_id long, text string").coalesce(1)
    rows = ls.build_index(docs, 100_000).collect()
    assert len(rows) > 2
    for row in rows:
        terms = bytes(row["terms"]).split(SPACE)
        assert len(terms) > 2 * len(row["doc_ids"]) and len(set(terms)) == len(terms)
        assert {len(v) for v in row if isinstance(v, list)} == {len(row["doc_ids"])}
        df = from_bytes(row["df"])
        assert len(df) == len(terms) and df.sum() == 40 * len(row["doc_ids"])


def test_one_shard_at_a_time_is_written_and_read(spark):
    docs = spark.createDataFrame(VARIED, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "w1 w2 w4999"), (2, "w700")], "item_id int, text string")
    before = set(scratch_paths())
    found = ls.lexical_search(docs, items, shard_bytes=100_000)
    (path,) = [p for p in scratch_paths() if p not in before and "/lexical_index-" in p]
    index = pq.ParquetDataset(path.removeprefix("file:"))
    groups = [group.num_rows for part in index.fragments for group in part.row_groups]
    assert len(groups) > 2 and set(groups) == {1}
    assert table(found.collect()) == table(brute(VARIED, [(1, "w1 w2 w4999"), (2, "w700")]))


@pytest.mark.parametrize("most", [0, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32])
def test_numbers_in_bytes(most):
    for values in ([], [most], [0, most, 1]):
        data = to_bytes(np.array(values, np.int64))
        assert from_bytes(data).tolist() == values
        assert len(data) == 1 + len(values) * (1 if not values or most < 256 else 2 if most < 65_536 else 4 if most < 2**32 else 8)


def opened(texts, penalty=lambda x: 200 + x):
    held, columns = build([t.encode() for t in texts])
    row = {k: v if k in ("gaps", "tfs", "terms") else np.asarray(v, np.int64) for k, v in columns.items()}
    return held, {t.decode(): i for i, t in enumerate(row["terms"])}, Shard(row, penalty)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 9), max_size=30), max_size=400),
    st.lists(st.tuples(st.integers(0, 9), st.integers(1, 50)), min_size=1, max_size=6, unique_by=lambda x: x[0]),
    st.floats(0, 1),
)
def test_pruned_search_equals_scoring_all(texts, query, share):
    held, number, shard = opened([" ".join(map(str, t)) for t in texts])
    full = {}
    for place, i in enumerate(held):
        c = Counter(texts[i])
        full[place] = sum(w * (10**9 * c[t] // (1000 * c[t] + 200 + len(texts[i]))) for t, w in query if c[t])
    least = max(1, int(share * max(full.values(), default=0)))
    known = [(number[str(t)], w) for t, w in query if str(t) in number]
    terms, weights = (np.array([x[k] for x in known], np.int64) for k in (0, 1))
    found, score = shard.search(terms, weights, least)
    assert dict(zip(found.tolist(), score.tolist(), strict=True)) == {d: s for d, s in full.items() if s >= least}


def test_candidates_are_rejected_before_blocks_are_unpacked():
    """A rare heavy term leaves few candidates; of the common list only blocks that could matter are read."""
    texts = [f"common {'rare ' * 3 if i in (700, 9_000) else ''}{'pad ' * (i % 50)}" for i in range(20_000)]
    _, number, shard = opened(texts)
    terms = np.array([number["rare"], number["common"]])
    found, score = shard.search(terms, np.array([1000, 10]), 1)
    assert len(found) == 20_000 and shard.unpacked_blocks > 150
    held, number, shard = opened(texts)
    found, score = shard.search(terms, np.array([1000, 10]), int(score.max()) * 9 // 10)
    assert found.tolist() == [700, 9_000] and shard.unpacked_blocks <= 3


def test_bounds_hold():
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 5, rng.integers(1, 300)))) for _ in range(1000)]
    _, number, shard = opened(texts, lambda x: 200 + 3 * x)
    for term in number.values():
        for block in range(shard.begin[term], shard.begin[term + 1]):
            assert shard.postings(np.array([block]))[1].max() == shard.block_peak[block]
