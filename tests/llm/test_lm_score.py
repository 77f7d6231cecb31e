"""Context-tree weighting against a direct recursion, and scores against a plain count."""

import math
import re
import tracemalloc
import uuid
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from area_trends.llm import context_trees as ct
from area_trends.llm import lm_score, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Direct:
    """The weighted trees by their definition."""

    def __init__(self, values, depth):
        self.depth, self.counts, self.children, self.memo = depth, {}, {}, {}
        for value in values:
            data = bytes([ct.EDGE]) * depth + value + bytes([ct.EDGE])
            for i in range(depth, len(data)):
                for step in range(8):
                    bit, one = (1 << step) | (data[i] >> (8 - step)), (data[i] >> (7 - step)) & 1
                    for d in range(depth + 1):
                        node = (bit, data[i - d : i])
                        self.counts.setdefault(node, [0, 0])[one] += 1
                        if d:
                            self.children.setdefault((bit, data[i - d + 1 : i]), set()).add(node)

    def kt(self, node):
        a, b = self.counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.memo:
            if len(node[1]) == self.depth:
                self.memo[node] = self.kt(node)
            else:
                below = sum(self.weighted(c) for c in self.children.get(node, ()))
                a, b = math.log(0.5) + self.kt(node), math.log(0.5) + below
                self.memo[node] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
        return self.memo[node]

    def chance(self, bit, one, context, d=0):
        node = (bit, context[len(context) - d :])
        if node not in self.counts:
            return 0.5
        a, b = self.counts[node]
        own = ((b if one else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        share = math.exp(math.log(0.5) + self.kt(node) - self.weighted(node))
        return share * own + (1 - share) * self.chance(bit, one, context, d + 1)

    def score(self, value):
        data, total = bytes([ct.EDGE]) * self.depth + value + bytes([ct.EDGE]), 0.0
        for i in range(self.depth, len(data)):
            for step in range(8):
                bit, one = (1 << step) | (data[i] >> (8 - step)), (data[i] >> (7 - step)) & 1
                total += math.log10(self.chance(bit, one, data[i - self.depth : i]))
        return total


def test_windows():
    found, sizes = ct.windows_of([b"ab", b"", b"c"], 2)
    rows = [[255, 255, 97], [255, 97, 98], [97, 98, 255], [255, 255, 255], [255, 255, 99], [255, 99, 255]]
    assert found.tolist() == [a << 16 | b << 8 | c for a, b, c in rows]
    assert sizes.tolist() == [3, 1, 2]


@pytest.mark.parametrize("max_nodes", [2_500_000, 300])
def test_scores(spark, max_nodes):
    rows = [(i, f"The cat {i % 5} sat on\tTHE mat é{i % 3}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "  "), (103, "Zebra zebra 漢字"), (103, "Zebra zebra 漢字"), (None, "the nowhere")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    model = Direct([lower(t).encode() for t in learned], ct.DEPTH)
    counts = Counter(w for t in learned for w in [*WORD.findall(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    found = sorted(lm_score.lm_scores(docs, max_nodes).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(found) == len(rows)
    for row, (doc_id, text) in zip(found, sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")), strict=True):
        words = [*WORD.findall(lower(text)), None]
        base = sum(math.log10((counts[w] + 1) / (n + (v + 1))) for w in words)
        assert row.doc_id == doc_id
        assert row.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.score == pytest.approx(model.score(lower(text).encode()), rel=1e-5)
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    rows = [(i, f"w{i} w{i % 7} common") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted(lm_score.lm_scores(docs).collect())
    monkeypatch.setattr(lm_score, "FREQUENT", 5)
    b = sorted(lm_score.lm_scores(docs).collect())
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x.base_score == pytest.approx(y.base_score)


def test_what_is_broadcast_is_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, bytes(rng.integers(97, 123, 40).tolist()).decode()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(lm_score.lm_scores(docs).collect())
    held, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: held.append(value) or send(value))
    parts = sorted(lm_score.lm_scores(docs, 400).collect())
    assert [r.score for r in parts] == pytest.approx([r.score for r in whole], rel=1e-9)
    assert max(len(column) for value in held if isinstance(value, tuple) for column in value) <= 400
    assert len(held) == 3  # roots, windows, words: the texts are scored in one pass


def test_memory_of_a_slice():
    rng = np.random.default_rng(6)
    windows, numbers = np.unique(rng.integers(0, 1 << 48, 200_000, np.uint64)), np.array([np.iinfo(np.int64).max])
    model = SimpleNamespace(value=(windows, np.zeros(len(windows)), np.arange(len(windows), dtype=np.int32)))
    words = SimpleNamespace(value=(numbers, np.zeros(1)))
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 50_000)) for _ in range(160)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(160)), "text": texts})
    score = lm_score.scoring(uuid.uuid4().hex, model, words)
    next(score([batch.slice(0, 1)]))
    tracemalloc.start()
    rows = sum(part.num_rows for part in score([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 160 and peak < 150e6


def gathered(batches):
    found = Counter()
    for batch in batches:
        for kind, key, n, everywhere in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[kind, key, "n"] += n
            found[kind, key, "everywhere"] += everywhere
    return found


def test_long_texts_come_in_parts(monkeypatch):
    values = ["", "short", "A longer text, é\t漢字 漢字 of words " * 5, "without_any_white_space" * 9, "x" * 60, "y" * 61]
    columns = {"row": list(range(6)), "text": values, "learned": [True, False, True, True, False, True]}
    batch = pa.RecordBatch.from_pydict(columns)
    windows = np.unique(ct.windows_of(lm_score.lowered(values))[0])
    logs, half = -np.arange(1.0, len(windows) + 1), np.arange(len(windows)) % 2 == 0
    model = (windows[half], logs[half], np.arange(half.sum(), dtype=np.int32))
    args = SimpleNamespace(value=model), SimpleNamespace(value=(np.array([np.iinfo(np.int64).max]), np.zeros(1)))
    counts = gathered(lm_score.counting([batch]))
    whole = [r for b in lm_score.scoring(uuid.uuid4().hex, *args)([batch]) for r in b.to_pylist()]
    for size in (7, 60):
        monkeypatch.setattr(lm_score, "COUNTED_BYTES", size)
        monkeypatch.setattr(lm_score, "SCORED_BYTES", size)
        assert gathered(lm_score.counting([batch])) == counts
        found = [r for b in lm_score.scoring(uuid.uuid4().hex, *args)([batch]) for r in b.to_pylist()]
        assert found == whole


def test_memory_of_a_long_text():
    rng = np.random.default_rng(8)
    text = bytes(rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 12_000_000)).decode()
    batch = pa.RecordBatch.from_pydict({"text": [text], "learned": [True]})
    tracemalloc.start()
    assert sum(1 for _ in lm_score.counting([batch])) == 7
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def test_groups_are_whole(monkeypatch):
    monkeypatch.setattr(ct, "WEIGHED", 5)
    suffix = np.sort(np.random.default_rng(7).integers(0, 12, 100))
    rows = pa.RecordBatch.from_arrays([pa.array(suffix), pa.array(np.arange(100))], ["suffix", "window"])
    found = list(ct.whole_groups(rows.slice(i, 3) for i in range(0, 100, 3)))
    assert np.concatenate([window for _, window in found]).tolist() == list(range(100))
    assert all(a[0][-1] < b[0][0] for a, b in zip(found, found[1:], strict=False)) and len(found) > 3
    assert list(ct.whole_groups([])) == []


def test_probabilities_add_up():
    rng = np.random.default_rng(3)
    model = Direct([bytes(rng.integers(97, 100, 30).tolist()) for _ in range(4)], 2)
    for context in (b"ab", b"zz"):
        total = 0.0
        for byte in range(256):
            p = 1.0
            for step in range(8):
                p *= model.chance((1 << step) | (byte >> (8 - step)), (byte >> (7 - step)) & 1, context)
            total += p
        assert total == pytest.approx(1)


def test_query(spark, sf):
    found = queries.op4_lm_score(spark, sf).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == queries.documents(spark, sf).count()
    assert sum(r.bits_per_byte for r in held) < 4 * len(held)
