"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from area_trends.sources.tables import materialise


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty), and the named further columns; others are not read."""
    return docs.select("doc_id", text_of(docs).alias("text"), *extra)


def worker_cache(name: str, make: Callable, version: str = ""):
    """A value that lives as long as the Python worker, so later tasks in it can reuse it.

    Only the latest version of a name is held, and only names of one operator (their first
    word), so the stages of a pipeline do not add up in a worker. The memory of dropped values goes
    back to the system.
    """
    held = sys.modules.setdefault("corpus_worker_cache", SimpleNamespace(values={})).values
    if others := [k for k in held if k.split()[0] != name.split()[0]]:
        for other in others:
            del held[other]
        gc.collect()
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()  # what numpy and the interpreter have freed
    if name not in held or held[name][0] != version:
        held.pop(name, None)
        held[name] = (version, make())
    return held[name][1]


def forget_caches(name: str) -> None:
    """Drops what operators of another first word have left in the Python worker."""
    worker_cache(name, lambda: None)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most `max_bytes` of a text column, or one row."""
    ends = batch.column(column).cast(pa.large_string())
    sizes = pa.compute.binary_length(ends).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + (size or 0) > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def text_parts(data: bytes, separators: re.Pattern[bytes], size: int) -> Iterator[bytes]:
    """Cuts UTF-8 at separators into parts of about `size` bytes, so that no word is cut."""
    at = 0
    while at < len(data):
        near = separators.search(data, at + size)
        end = near.start() if near else len(data)
        yield data[at:end]
        at = end


def number_rows(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds the row's position (1, 2, ...) in an order over all rows.

    Rows are sorted by ranges and written; a row's position is its place in its range plus
    the sizes of the ranges before, one small row each. Equal rows are numbered as they lie.
    """
    placed = materialise(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return placed.join(F.broadcast(before), "_range").select(*rows.columns, place.alias(name))


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of their own, `_row`, written once; columns are c0, c1, ... in their order."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return materialise(held.withColumn("_row", F.monotonically_increasing_id()), "documents")


def place_of(docs: DataFrame, name: str) -> str:
    """The name that `numbered` gives a column."""
    return f"c{docs.columns.index(name)}"


def restored(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`numbered` rows with the columns of the documents."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
