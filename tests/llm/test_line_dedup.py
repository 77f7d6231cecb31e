"""Line deduplication against all pairs of lines."""

import random
import time

import pytest
from area_trends.llm import line_dedup as ld
from area_trends.llm import queries
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, threshold):
    if a == b:
        return True
    if abs(len(a) - len(b)) > threshold:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    return max(len(a), len(b)) <= threshold or distance(a, b) <= threshold


def brute(rows, threshold=2, min_chars=20):
    """n_lines, n_removed and text for each doc_id (each given once)."""
    places = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if len(x) >= min_chars]
    lines = sorted({x for _, _, x in places}, key=lambda x: (len(x), x))
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > threshold:
                break
            if near(a, b, threshold):
                parent[find(b)] = find(a)
    seen, gone = set(), set()
    for doc_id, n, x in sorted(places):
        if find(x) in seen:
            gone.add((doc_id, n))
        seen.add(find(x))
    for doc_id, t in rows:
        split = (t or "").split("\n")
        kept = [x for n, x in enumerate(split) if (doc_id, n) not in gone]
        yield doc_id, len(split), len(split) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_distance(spark, threshold):
    rng = random.Random(threshold)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé漢") for _ in range(rng.randint(threshold + 1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, threshold + 2)):
            at = rng.randrange(len(b) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                b.insert(at, rng.choice("abé漢"))
            elif b and at < len(b):
                b[at : at + 1] = [] if kind == 1 else [rng.choice("abé漢")]
        b = "".join(b)
        if abs(len(a) - len(b)) <= threshold < min(len(a), len(b)):
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select("a", "b", ld.edits_within(F.col("a"), F.col("b"), threshold).alias("d"))
    for c in "ab":
        lines = found.withColumns({"line": F.col(c), "length": F.char_length(c)})
        found = ld.with_segment_keys(lines, threshold).withColumnRenamed("keys", f"k{c}").drop("line", "length")
    found = found.withColumn("met", F.arrays_overlap("ka", "kb"))
    for a, b, d, _, _, met in found.collect():
        true = distance(a, b)
        assert min(d, threshold + 1) == min(true, threshold + 1)
        assert met or true > threshold


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    found = sorted(map(tuple, queries.op3_line_dedup(spark, sf).collect()))
    expected = sorted(brute(rows))
    assert found == expected
    assert sum(r[2] for r in expected) > 10


def test_near_lines_chains_and_edges(spark):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(1, f"{base}\nshort\n\n"), (2, base.replace("quick", "quack")), (3, base.replace("quick", "quaek") + "s!")]
    rows += [(4, "x" + base[1:] + "\nkeep this line of text please"), (5, None), (6, ""), (7, "short\n" + "é" * 25 + "\n" + "é" * 24)]
    rows += [(8, "\n\n"), (9, "z" * 5000 + "\n" + "z" * 4999), (10, base), (11, "only one line here, unlike others")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, node string")
    assert sorted(map(tuple, ld.line_dedup(docs).collect())) == sorted(brute(rows))
    kept = ld.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    found = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert found == {
        1: (f"{base}\nshort\n\n", 1), 3: (rows[2][1], 1), 4: ("keep this line of text please", 29), 5: (None, 1), 6: ("", 1),
        7: ("short\n" + "é" * 25, 31), 8: ("\n\n", 1), 9: ("z" * 5000, 5000), 11: ("only one line here, unlike others", 1),
    }
    assert ld.line_dedup(docs.limit(0)).count() == 0


def test_repeated_and_missing_ids(spark):
    line = "a line that is long enough to count"
    rows = [(3, line), (3, line), (None, line), (4, line), (3, "another text with the same id\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, ld.line_dedup(docs).select("doc_id", "n_removed", "text").collect()), key=str)
    assert found == sorted(
        [(3, 0, line), (3, 0, line), (None, 0, line), (4, 1, ""), (3, 1, "another text with the same id")], key=str
    )


def test_native(spark, sf):
    plan = queries.op3_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_removed_lines_of_one_text(spark):
    """Lines are cut by their places, in a pass over the text however many go."""
    n = 30_000
    lines = [f"line number {i}" for i in range(n)]
    gone = list(range(0, n, 3)) + [n - 1]
    docs = spark.createDataFrame([("\n".join(lines), gone)], "text string, at array<int>")
    split = F.split("text", "\n", -1)
    marks = F.transform("at", lambda i: F.struct(i.alias("line_no"), F.xxhash64(F.get(split, i)).alias("node")))
    marked = docs.select(split.alias("lines"), marks.alias("marks"))
    start = time.monotonic()
    kept = marked.select(ld.without_marked(F.col("lines"), F.col("marks")).alias("x")).first()["x"]
    assert time.monotonic() - start < 30
    out = set(gone)
    assert kept == [x for i, x in enumerate(lines) if i not in out]
    for held in ([], [0], [2], [0, 1, 2], [5], [1, 7]):
        some = spark.createDataFrame([(["a", "b", "c"], held)], "lines array<string>, at array<int>").select(
            "lines",
            F.transform("at", lambda i: F.struct(i.alias("line_no"), F.xxhash64(F.get("lines", i)).alias("node"))).alias("marks"),
        )
        found = some.select(ld.without_marked(F.col("lines"), F.col("marks")).alias("x")).first()["x"]
        assert found == [x for i, x in enumerate("abc") if i not in held]


def test_alike_ends_are_not_compared_one_by_one(spark):
    """Long lines that differ in the middle, in their ends, or by a repeated character."""
    pairs = [("a" * n, "a" * m) for n in (3, 4, 9) for m in (3, 4, 5, 9) if abs(n - m) <= 2]
    pairs += [("xyaaa", "aaaxy"), ("abcabc", "abcabcab"), ("éabab", "ababé"), ("aab", "baa"), ("abcdé", "abxcdé")]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld.edits_within(F.col("a"), F.col("b")))
    for a, b, d in found.collect():
        assert min(d, 3) == min(distance(a, b), 3)
    line = F.concat(F.repeat(F.lit("lorem ipsum é "), 600), F.col("id").cast("string"), F.repeat(F.lit(" dolor sit"), 600))
    other = F.replace(line, F.col("id").cast("string"), F.concat(F.col("id").cast("string"), F.lit("x")))
    long = spark.range(1000, 1400).select(line.alias("a"), other.alias("b"))
    start = time.monotonic()
    assert {r[0] for r in long.select(ld.edits_within(F.col("a"), F.col("b"))).collect()} == {1}
    assert time.monotonic() - start < 15
