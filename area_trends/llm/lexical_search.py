"""Ranked lexical search: Block-Max MaxScore over an index per shard, heaps merged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from area_trends.llm.common import slices, text_of
from area_trends.llm.lexical_index import COLUMNS, SPACE, Shard, build, from_bytes, to_bytes, words_of
from area_trends.sources.tables import materialise

SHARD_BYTES = 8_000_000
#: most terms of items that are broadcast, and searched, at a time; an item is never split
BLOCK_TERMS = 500_000
BEST = 10
#: writer options for an index: a row group holds one shard, so that writers and readers hold one at a time;
#: otherwise a group's size is looked at after 100 rows only, and a reader opens all shards of a group at once
ONE_BY_ONE = {
    "parquet.block.size": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}


def in_bytes(column) -> bytes:
    """A column of `build` as one value: bytes as they are, terms side by side, numbers by `to_bytes`."""
    if isinstance(column, bytes):
        return column
    return SPACE.join(column) if isinstance(column, list) else to_bytes(column)


def terms_of(column: pa.Array) -> pa.ListArray:
    """The terms of each index row."""
    return pc.split_pattern(column, SPACE.decode())


def indexing(shard_bytes: int) -> Callable:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_end"))
                held, columns = build([x.as_buffer().to_pybytes() for x in part.column("text").cast(pa.binary())])
                if not held:
                    continue
                ids = part.column("doc_id").take(pa.array(held, pa.int64()))
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                for name, kind in COLUMNS.items():
                    if kind == "binary":
                        arrays.append(pa.array([in_bytes(columns.pop(name))], pa.binary()))
                        continue
                    values = pa.array(columns.pop(name), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_ids", *COLUMNS])

    return run


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per shard of about `shard_bytes` of text, or of one longer text; terms of all documents.

    A row holds the doc_ids in ascending order (null last), the documents' lengths, the terms with their
    numbers of documents, and the postings in blocks of up to 128, with each block's
    first document and bounds. It can be saved, best with `ONE_BY_ONE`, and searched many times.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{name} {of}" for name, of in COLUMNS.items())
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(indexing(shard_bytes), f"doc_ids array<{kind}>, {columns}")


def counting_terms(batches):
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            number: dict[bytes, int] = {}
            for words in words_of(text.encode("utf-8", "replace")):
                for word in words:
                    number[word] = number.get(word, 0) + 1
            item = pa.repeat(batch.column("_item")[i], len(number))
            columns = [item, pa.array(list(number), pa.binary()), pa.array(list(number.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_item", "term", "times"])


def known_terms(held) -> Callable:
    def run(batches):
        wanted = pa.array(held.value, pa.binary())
        for batch in batches:
            for terms, df in zip(terms_of(batch.column("terms")), batch.column("df"), strict=True):
                place = pc.index_in(terms.values, value_set=wanted)
                found = pc.is_valid(place)
                columns = [terms.values.filter(found), pa.array(from_bytes(df.as_buffer())).filter(found)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "df"])

    return run


def document_counts(index: DataFrame, terms: list[bytes]) -> DataFrame:
    """term and df: its number of documents, for those of these terms that occur."""
    held = index.sparkSession.sparkContext.broadcast(terms)
    found = index.select("terms", "df").mapInArrow(known_terms(held), "term binary, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


def plain(scalar: pa.Scalar, name: str):
    if name in ("gaps", "tfs"):
        return scalar.as_buffer()
    if COLUMNS[name] == "binary":
        return from_bytes(scalar.as_buffer())
    return scalar.values.to_numpy(zero_copy_only=False).astype(np.int64)


def searching(held, n_docs: int, n_terms: int, best: int) -> Callable:
    def penalty(lengths: np.ndarray) -> np.ndarray:
        return 8 * (25 + 75 * lengths * n_docs // n_terms)

    def run(batches):
        terms, items = held.value
        wanted = pa.array(terms, pa.binary())
        heaps: dict[int, list[tuple]] = {item: [] for item, _, _ in items}
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                here = pc.index_in(wanted, value_set=terms_of(batch.column("terms").slice(i, 1)).values)
                here = here.to_numpy(zero_copy_only=False)
                here = np.where(np.isnan(here), -1, here).astype(np.int64) if here.dtype.kind == "f" else here
                shard = Shard({c: plain(row[c], c) for c in COLUMNS if c != "terms"}, penalty)
                ids = row["doc_ids"].values
                for item, numbers, weights in items:
                    place = here[numbers]
                    heap = heaps[item]
                    least = heap[-1][0] if len(heap) == best else 1
                    found, score = shard.search(place[place >= 0], weights[place >= 0], least)
                    first = np.lexsort((found, -score))[:best]
                    if len(first):
                        new = ids.take(pa.array(found[first])).to_pylist()
                        heap += zip(score[first].tolist(), new, strict=True)
                        heap.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                        del heap[best:]
        rows = [(item, doc, score) for item, heap in heaps.items() for score, doc in heap]
        if kind is not None:
            numbers, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(numbers, pa.int64()), pa.array(docs, kind), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_item", "doc_id", "score"])

    return run


def search(
    index: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS, key: str = "item_id"
) -> DataFrame:
    """item_id (the key), rank, doc_id and score of each item's `best` documents in a stored index.

    A term is a run of digits, letters (A-Z in lower case) and characters above ASCII. Its
    weight is floor(1000 ln((2N + 2) / (2 df + 1))) over the N documents with a term; a document
    scores the sum over the item's terms, repeats included, of weight times
    10^9 tf div (1000 tf + 8 m), where m is 25 plus 75 times its length over the mean. Equal
    scores rank by doc_id, null last; documents without a score are left out, as are items without terms.
    Rows that repeat an item are items of their own, as are rows that repeat a document.

    The terms of up to `block_terms` items' terms are broadcast at a time, and the index is
    gone through once per block. A task keeps one heap per item over all its shards, so
    that its bounds tighten from shard to shard; the heaps of all tasks are merged.
    """
    spark, kind = items.sparkSession, items.schema[key].dataType.simpleString()
    rows = items.select(F.col(f"`{key}`").alias("_key"), text_of(items).alias("text"))
    rows = materialise(rows.withColumn("_item", F.monotonically_increasing_id()), "items")
    terms = rows.select("_item", "text").mapInArrow(counting_terms, "_item long, term binary, times long")
    terms = materialise(terms, "item_terms")
    n_terms = F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x)
    whole = index.agg(F.sum(F.size("lengths").cast("long")).alias("docs"), F.sum(n_terms).alias("terms")).first()
    n_docs, n_terms = whole["docs"] or 0, whole["terms"] or 0
    blocks = terms.count() // block_terms + 1
    schema = f"_item long, doc_id {index.schema['doc_ids'].dataType.elementType.simpleString()}, score long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks if n_docs else 0):
        chosen = terms.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).collect()
        names = sorted({bytes(r["term"]) for r in chosen})
        counts = document_counts(index, names)
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
        weights = {bytes(r["term"]): r["weight"] for r in counts.select("term", weight.alias("weight")).collect()}
        number = {name: i for i, name in enumerate(names)}
        queries: dict[int, list[tuple[int, int]]] = {}
        for r in chosen:
            if w := weights.get(bytes(r["term"])):
                queries.setdefault(r["_item"], []).append((number[bytes(r["term"])], w * r["times"]))
        asked = [(item, *np.array(q, np.int64).T) for item, q in sorted(queries.items())]
        held = spark.sparkContext.broadcast((names, asked))
        tops = index.mapInArrow(searching(held, n_docs, n_terms, best), schema)
        found = found.union(materialise(tops, "heaps"))
    order = W.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    named = ranked.join(rows.select("_item", "_key"), "_item")
    return named.select(F.col("_key").cast(kind).alias(key), "rank", "doc_id", "score")


def lexical_search(
    docs: DataFrame, items: DataFrame, best: int = BEST, shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """`search` over an index of the documents that is written for this call.

    Texts are read once and not shuffled. Null and empty texts hold no term and are never found;
    without documents or items there are no rows; other columns are ignored.
    """
    index = materialise(build_index(docs, shard_bytes), "lexical_index", ONE_BY_ONE)
    return search(index, items, best, block_terms)
