"""Fingerprints against a direct pass over all documents in order."""

import hashlib

import numpy as np
import pytest
from area_trends.llm import queries
from area_trends.llm import spot_signatures as ss


def direct(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    spots = ss.Spots()
    sets = lambda t: next(spots.sets([t]))
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        a, b, c = sets(text), sets(edited), sets(after)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        yield doc_id, n, digest, ss.written(a), ss.written(b), ss.likeness(a, b), ss.likeness(a, c)


def test_query(spark, sf):
    rows = queries.documents(spark, sf).select("doc_id", "text").collect()
    found = sorted(map(tuple, queries.op8_fingerprints(spark, sf).collect()))
    assert found == sorted(direct(map(tuple, rows)))
    assert np.mean([r[5] for r in found]) > 0.35 > 0.1 > np.mean([r[6] for r in found])


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_order_and_edges(spark, n):
    rows = [(i * 10, f"the cat{i} sat{i} on a mat{i} " * (i % 4)) for i in range(n)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_chars int").repartition(5)
    assert sorted(map(tuple, ss.fingerprints(docs).collect())) == sorted(direct(rows))


def test_rows(spark):
    rows = [(5, None), (9, ""), (9, "é the b c"), (9, "é the b c"), (2, "the of"), (None, "x" * 100_000), (None, "!!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, ss.fingerprints(docs).collect()), key=str)
    assert found == sorted(direct(rows), key=str)
    assert ss.fingerprints(docs.limit(0)).count() == 0


def test_signatures():
    spots = ss.Spots()
    a, b, c, d = spots.sets(["The cat is on a big mat", "the CAT; is on a big mat", "", "the of"])
    assert np.array_equal(a, b) and len(a) == 4 and not len(c) and len(d) == 1
    assert ss.likeness(a, b) == 1.0 and ss.likeness(c, c) == 1.0 and ss.likeness(a, c) == 0.0
    assert ss.likeness(np.arange(4), np.arange(10), 0.5) == 0.0 and ss.likeness(np.arange(4), np.arange(5), 0.8) == 0.8


def test_texts_without_anchors():
    """Every word counts where no chain after a common word holds it."""
    lists = ["kat | mos | pel | rin | sul | tev", "kat | mos | pel | rin | sul | xxx", "kat | mos | other | words | here | now"]
    lists += ["кот сидит у окна дома", "кот сидит у двери дома", "the kat mos pel rin", "the kat mos pel sul"]
    sets = list(ss.Spots().sets(lists))
    assert len({s.tobytes() for s in sets}) == len(sets)
    assert 0.3 < ss.likeness(sets[0], sets[1]) < 1 and ss.likeness(sets[0], sets[2]) < 0.2
    assert 0 < ss.likeness(sets[3], sets[4]) < 1


def test_near_components(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 4, 10, 30, 80):
        base = [f"w{x}" for x in rng.integers(0, 300, n * 3)]
        base[::3] = ["the"] * len(base[::3])
        for edits in (0, 0, 1, 2, 5):
            text = list(base)
            for at in rng.integers(0, len(text), edits):
                text[at] = f"x{at}"
            rows.append((len(rows), " ".join(text)))
    sets = list(ss.Spots().sets([t for _, t in rows]))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in ss.near_components(docs).orderBy("doc_id").collect()] == label
