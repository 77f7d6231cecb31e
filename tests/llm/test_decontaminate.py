"""FM-index and decontamination against direct search."""

import hashlib
import re

import numpy as np
from area_trends.llm import decontaminate as dc
from area_trends.llm import queries
from area_trends.llm.fm_index import FMIndex, suffix_order
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (window := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[window]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(found), digest, bool(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=6), st.lists(st.integers(2, 3), min_size=1, max_size=4))
def test_index(rows, phrase):
    shard = np.concatenate([x for r in rows for x in (np.array(r, np.int64), [0])]).astype(np.int64)
    codes = [(-1000 + sum(1 for y in shard[:i] if y == 0), 0) if x == 0 else (x, 1) for i, x in enumerate(shard.tolist())]
    direct = sorted(range(len(shard)), key=lambda i: codes[i:])
    assert suffix_order(shard).tolist() == direct
    found, at = FMIndex(shard, 3).search(np.array([phrase]), np.array([len(phrase)]))
    n = len(phrase)
    assert sorted(at.tolist()) == [i for i in range(len(shard)) if shard[i : i + n].tolist() == phrase]


def test_query(spark, sf):
    found = sorted(map(tuple, queries.op7_decontamination(spark, sf).collect()))
    docs = queries.documents(spark, sf).select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    assert found == sorted(brute(docs, items))
    assert any(r[-1] for r in found)


ITEMS = [(1, "one two three four"), (2, "One, two-three"), (2, "x"), (3, None), (4, "..."), (5, "one two three four")]
DOCS = [
    (1, "Zero ONE two; three! four five", "k"),
    (2, None, "k"),
    (3, "", "k"),
    (4, "one two threefour", "k"),
    (4, "one two threefour", "k"),
    (5, "one two three one two three four x x", "k"),
    (None, "é one two three", "k"),
]


def test_rows_and_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, phrases string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted(brute([d[:2] for d in DOCS], ITEMS, 3), key=str)
    assert sorted(map(tuple, dc.contamination(docs, items, 3).collect()), key=str) == expected
    assert sorted(map(tuple, dc.contamination(docs, items, 3, block_bytes=100).collect()), key=str) == expected
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in dc.contamination(docs, items.limit(0)).collect()} == {0}


def test_removal(spark):
    docs = spark.createDataFrame([(*d, 3) for d in DOCS], "doc_id long, text string, hits string, n_chars int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.remove_contamination(docs, items, 3)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    rows = {(r.doc_id, r.text, r.hits, r.n_chars) for r in found.collect()}
    assert rows == {
        (1, "Zero  five", "k", 10), (2, None, "k", 3), (3, "", "k", 0), (4, "one two threefour", "k", 17),
        (5, "", "k", 0), (None, "é ", "k", 2),
    }


def test_one_worker_for_each_task(spark):
    """Marking and cutting are one Python step: two in a task would be two workers, each with its memory."""
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, 0)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    cut = dc.remove_contamination(docs, items)
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in cut.orderBy("doc_id").collect()] == [(1, "a  c", 4), (2, None, 0)]
