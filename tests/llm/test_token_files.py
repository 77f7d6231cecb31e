"""Token files: exact round trip against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
from area_trends.llm import queries, token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(rows):
    start = 0
    for doc_id, text in sorted(rows):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query(spark, sf):
    docs = queries.documents(spark, sf).select("doc_id", "text").collect()
    found = sorted(map(tuple, queries.op9_token_files(spark, sf).collect()))
    assert found == list(expected(map(tuple, docs)))


def test_files(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"  word {i}<|endoftext|>  x\n \ny", "extra") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, PATH, shards=4)
    parts = sorted((tmp_path / "ids").glob("*.orc"))
    held = [pyarrow.orc.ORCFile(p).read().to_pylist() for p in parts]
    assert [r["doc_id"] for part in held for r in part] == list(range(200))
    for row in (r for part in held for r in part):
        text = rows[row["doc_id"]][1] or ""
        assert row["ids"] == [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]
    assert [r.doc_id for r in token_files.read_ids(spark, path, [5, 77]).orderBy("doc_id").collect()] == [5, 77]
    found = sorted(map(tuple, token_files.token_positions(spark, path).collect()))
    assert found == list(expected((i, t) for i, t, _ in rows))


def test_repeated_null_and_empty(spark):
    rows = [(2, "b"), (2, "a"), (2, "a"), (None, "n"), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_files.token_files(docs, PATH).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 2, 2]
    assert [r.start for r in found] == [0, 2, 3, 5, 7]
    assert token_files.token_files(docs.limit(0), PATH).count() == 0


def scanned(df):
    """Rows that the scan of a small read returned, after stripes and row groups were skipped."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_few_ids_skip_row_groups(spark, tmp_path):
    """Ranges of doc_id leave one row group to read; an id that is not there is ruled out by its Bloom filter."""
    rows = [(2 * i, f"word {i}") for i in range(20_000)]
    path = str(tmp_path / "ids")
    token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, shards=2)
    some = token_files.read_ids(spark, path, [2 * 7777])
    assert some.count() == 1 and 0 < scanned(some) <= token_files.ROWS_PER_INDEX
    far = token_files.read_ids(spark, path, [2 * 5, 2 * 19_990])
    assert far.count() == 2 and scanned(far) <= 2 * token_files.ROWS_PER_INDEX
    absent = [token_files.read_ids(spark, path, [2 * i + 1]) for i in (1000, 4321, 9000, 15_555)]
    assert sorted(map(scanned, absent))[:3] == [0, 0, 0]
    assert scanned(token_files.read_ids(spark, path)) == 20_000


def test_words_that_go_to_the_model(spark):
    words = ["straße", "naïve", "Ĳssel", "ǅ", "ª", "don't", "áb", "x1", "été,", "Ω", "ﬁn", "ŉ", "a" * 3000, "œ.", "don’t"]
    rows = [(i, f"{w} {w}  {w} {w}{w}\n{w}, {w}.") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, token_files.token_files(docs, PATH).collect())) == list(expected(rows))


def test_line_ends_cut_parts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = [
        "zebra", "zebra zebra.\nZebra zebra,\nélan zebra\nZebra. x", "zebra.\n", "\nzebra a\n\nb. c.\n d e \nf",
        "a.\nit's a...\nb a-\nc a.\n漢 a.,\nb ª\nº <|endoftext|>zebra\nzebra", "", "\n", " \n", " a\nb",
    ]
    ids, sizes = encoder.encode(texts, 0)
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w]
    assert sizes.tolist() == [len(w) for w in want]
    known = len(encoder.numbers)
    encoder.encode(["x zebra.\nZebra zebra,\nZebra"], 0)
    fresh = set(list(encoder.numbers)[known:])
    assert fresh == {b"x", "zebra,\nZebra"}  # the lines are made of parts met before


def test_repeated_words_are_looked_up_once(monkeypatch):
    """Texts that share their words cost a look-up for each different word of a slice."""
    rng = np.random.default_rng(5)
    words = ["a", "the", "été", "end.", "end,", "line\nnext", "stop.\nnext", "x1", "", "漢字", "(odd)", "don't", "\t", "'s"]
    values = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 40, 300)]
    values += ["", " ", "  ", "a", " a", "a ", "\n", "a  b", "a \t b", "<|endoftext|> a", "a <|endoftext|>b", "<|endoftext|>", "é\nb", "a.\nb c"]
    encoder, seen = token_files.Encoder(PATH), []
    learn = token_files.Encoder.learn
    monkeypatch.setattr(token_files.Encoder, "learn", lambda self, alone, some: seen.append(len(some)) or learn(self, alone, some))
    for some in (values, values[::-1], values[-1:], []):
        if some:
            ids, sizes = encoder.encode(some, 0)
            expected = [[*LIBRARY.encode(v, add_special_tokens=False).ids, 0] for v in some]
            assert ids.tolist() == [n for x in expected for n in x] and sizes.tolist() == list(map(len, expected))
    assert seen[0] < 60
