"""Language identification: held-out accuracy, rejection and edge cases."""

import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from area_trends.llm import language_id as li
from area_trends.llm import queries


def test_held_out_accuracy(spark, sf):
    found = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    docs = queries.documents(spark, sf).collect()
    assert len(found) == len(docs)
    right = total = kept = 0
    for row in docs:
        got = found[row.doc_id]
        assert got.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= got.score <= 1
        if got.held_out and row.lang is not None:
            total += 1
            right += got.lang_pred == row.lang
            kept += not got.rejected
    assert right >= 0.97 * total
    assert kept >= 0.97 * total


def test_learns_only_from_its_fold(spark, sf):
    docs = queries.documents(spark, sf)
    spoiled = docs.withColumn("lang", li.F.when(li.fold(docs, 3) == 1, "zz").otherwise(docs["lang"]))
    a = {r.doc_id: r.lang_pred for r in li.language_id(docs).collect()}
    b = {r.doc_id: r.lang_pred for r in li.language_id(spoiled).collect()}
    assert a == b


def test_rows(spark):
    many = [(i, "der die das und nicht" if i % 2 else "the of and that with", "de" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, "the and", None), (103, "the and", None)]
    docs = spark.createDataFrame([(*r, "x") for r in many + odd], "doc_id long, text string, lang string, score string")
    found = li.language_id(docs).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 65
    for i in (100, 101, 102):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[103].lang_pred == "en" and not by_id[103].rejected
    assert li.language_id(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", li.F.lit(None).cast("string"))
    assert {r.lang_pred for r in li.language_id(none).collect()} == {"und"}


def test_buckets_stay_within_words():
    a, starts = li.subword_buckets(["ab cd", "", "ab"])
    assert starts.tolist() == [0, 6, 7]
    one, _ = li.subword_buckets(["ab"])
    for order in range(len(a)):
        assert np.array_equal(a[order][7:10], one[order])
        assert a[order][6] == li.BUCKETS or order == 0


UNLEARNED = [
    "asdf qwer zxcv",
    "xkqj vwzzt qqpfh zxxw jkvbq wqzx",
    "Съешь ещё этих мягких французских булок да выпей чаю, и потом иди домой спать",
    "我们今天去公园散步然后回家吃饭",
    "Zażółć gęślą jaźń, wszystkie ptaki śpiewają w lesie o poranku",
    "Όλα τα πουλιά τραγουδούν στο δάσος το πρωί",
]


def test_rejects_letter_junk_and_unlearned_languages(spark, sf):
    """Junk goes, however sure the softmax is; rows of the held-out fold stay, junk or not they are of its languages."""
    docs = queries.documents(spark, sf).select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(UNLEARNED)], docs.schema)
    found = li.language_id(docs.unionByName(junk)).collect()
    strange = [r for r in found if r.doc_id >= 10_000_000]
    assert len(strange) == len(UNLEARNED) and all(r.rejected and r.score < 0.5 for r in strange)
    own = [r for r in found if r.doc_id < 10_000_000 and r.held_out and r.lang_pred != "und"]
    assert sum(r.rejected for r in own) <= 0.01 * len(own)
    kept = li.keep_identified(docs.unionByName(junk))
    assert kept.where("doc_id >= 10000000").count() == 0


def test_limits_come_from_all_learned_rows(spark):
    rows = [(f"the of and that with it was {'very ' * (i % 7)}", "en") for i in range(400)]
    rows += [(f"der die das und nicht ein {'sehr ' * (i % 5)}", "de") for i in range(400)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = li.fit(docs, rows_per_label=40)
    probability, familiar = model.scores([r[0] for r in rows])
    for k, label in enumerate(model.labels):
        here = np.array([r[1] == label for r in rows])
        assert model.least_familiar[k] <= familiar[here].min() - li.MARGIN + 1e-9
        assert model.least_score[k] <= 0.5
    assert 2.0**-10 < model.temperature < 2.0**6.75


def test_memory_of_prediction():
    """A batch is worked on in small slices, so a worker holds little beside its texts."""
    width = li.BUCKETS + 1
    model = li.Model(
        list("abcd"), np.zeros((width, 4), np.float32), np.zeros(4), 1.0, np.zeros(width), np.zeros(4), np.zeros(4)
    )
    values = pa.array(["some words of one text " * 200] * 2000)
    batch = pa.RecordBatch.from_arrays([values], ["text"])
    tracemalloc.start()
    found = sum(b.num_rows for b in li.predicting(SimpleNamespace(value=model), li.LETTER, False)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2000 and peak < 60_000_000
