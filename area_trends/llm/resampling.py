"""Resampling of documents towards a target by CRC bucket histograms of word runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from area_trends.llm.common import number_rows, slices, text_of, text_parts
from area_trends.sources.tables import materialise

LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
PART_BYTES = 200_000
SLICE_BYTES = 1_000_000

#: words of a text whose letters A-Z are in lower case
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def splitter() -> pre_tokenizers.Split:
    """The untrained pre-tokeniser: matches stay, with their offsets, all between them goes."""
    return pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)


def byte_offsets(line: str, data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Offsets in characters as offsets in UTF-8 bytes."""
    if len(line) == len(data):
        return offsets
    begins = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
    return np.append(begins, len(data))[offsets]


def run_codes(text: str, split: pre_tokenizers.Split, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """Part by part the number of words, and the CRC-32 of each run of 1 to `longest` words.

    The words of a part stand in one line, with single spaces, behind the last words of
    the part before; a run is the bytes of this line from the offset of its first word to
    the end of its last. The runs that end in the part are its runs.
    """
    carried: list[str] = []
    for part in text_parts(text.encode("utf-8", "replace").lower(), BETWEEN, PART_BYTES):
        found = split.pre_tokenize_str(part.decode())
        words = carried + [word for word, _ in found]
        lengths = [len(word) for word in carried] + [end - start for _, (start, end) in found]
        line = " ".join(words)
        data = line.encode()
        ends = np.cumsum(np.array(lengths, np.int64) + 1) - 1
        starts = byte_offsets(line, data, ends - np.array(lengths, np.int64)).tolist()
        ends = byte_offsets(line, data, ends).tolist()
        view, old = memoryview(data), len(carried)
        codes = [
            crc32(view[start:end])
            for n in range(1, longest + 1)
            for start, end in zip(starts[max(old + 1 - n, 0) :], ends[max(old, n - 1) :], strict=False)
        ]
        yield len(found), np.array(codes, np.uint32)
        carried = words[len(words) - min(longest - 1, len(words)) :]


def bucketing(longest: int, buckets: int) -> Callable:
    def run(batches):
        split = splitter()
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                sizes, found, ends = [], [np.zeros(0, np.int32)], [0]
                for text in rows.column("text").to_pylist():
                    parts = list(run_codes(text, split, longest))
                    found += [(codes % buckets).astype(np.int32) for _, codes in parts]
                    sizes.append(sum(n for n, _ in parts))
                    ends.append(ends[-1] + sum(len(codes) for _, codes in parts))
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                columns = [rows.column("doc_id"), pa.array(sizes, pa.int64()), held]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs"])

    return run


def bucket_runs(docs: DataFrame, key: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id (the key), n_words and runs: the bucket of each run of words of a text, with repeats."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(docs).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(bucketing(longest, buckets), f"doc_id {kind}, n_words long, runs array<int>")


def counting(buckets: int) -> Callable:
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("runs").flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    return run


def histogram(runs: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket and its number of runs in all texts; each task sends a row per bucket at most."""
    found = runs.select("runs").mapInArrow(counting(buckets), "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(runs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain: thousandths of the log ratio of its smoothed shares in target and rows."""
    every = runs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(histogram(runs, "s", buckets), "bucket", "left").join(
        histogram(target, "t", buckets), "bucket", "left"
    )
    counts = counts.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    counts = materialise(counts, "buckets")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    share = (F.col("t") + 1) * F.lit(total["s"] + buckets) / ((F.col("s") + 1) * F.lit(total["t"] + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def summing(gains) -> Callable:
    def run(batches):
        gain = np.array(gains.value, np.int64)
        for batch in batches:
            runs = batch.column("runs")
            before = np.append(0, np.cumsum(gain[runs.flatten().to_numpy()]))
            ends = np.cumsum(np.append(0, runs.value_lengths().to_numpy()))
            columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(np.diff(ends).astype(np.int64))]
            columns.append(pa.array(before[ends[1:]] - before[ends[:-1]]))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise that depends on the seed and the doc_id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    target_key: str = "item_id",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document.

    Features are the runs of 1 to `longest` words (digits, letters with A-Z in lower case,
    characters above ASCII), hashed to `buckets`. A bucket's gain compares its share in the
    target texts with its share in all documents; weight is the sum over a document's
    features, score adds noise drawn from seed and doc_id, so that the highest scores are a
    sample without replacement. Of the documents with `least_words`, `percent` (rounded down)
    are drawn and ranked from 1; others have no rank. Equal scores are drawn by doc_id, null
    last. Null and empty texts have no features and weight 0; a null doc_id draws noise as an
    empty one; repeated rows are drawn one by one; without documents nothing is returned, without
    targets all gains follow from the smoothing. Other columns are ignored.

    Texts are split once, part by part; their buckets are written, counted with one row per
    task and bucket, and summed with the gains, `buckets` numbers that go over the driver.
    Only doc_ids and numbers are sorted.
    """
    runs = materialise(bucket_runs(docs, "doc_id", longest, buckets), "document_runs")
    wanted = materialise(bucket_runs(target, target_key, longest, buckets), "target_runs")
    gains = bucket_gains(runs, wanted, buckets).orderBy("bucket").collect()
    held = docs.sparkSession.sparkContext.broadcast([r["gain"] for r in gains])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = runs.mapInArrow(summing(held), f"doc_id {kind}, n_words long, n_features long, weight long")
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    enough = F.col("n_words") >= least_words
    placed = number_rows(rows, enough.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), name="rank")
    n = runs.agg(F.sum(enough.cast("long"))).first()[0] or 0
    drawn = enough & (F.col("rank") <= percent * n // 100)
    return placed.withColumn("rank", F.when(drawn, F.col("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with all their columns, by doc_id; rows that repeat one come together."""
    kept = resample(docs, target, **options).where(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
