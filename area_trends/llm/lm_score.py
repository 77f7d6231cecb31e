"""Code lengths of texts under context-tree weighting, beside a word unigram base."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from area_trends.llm.common import forget_caches, slices, text_parts, texts, worker_cache
from area_trends.llm.context_trees import Scorer, weigh, window_parts
from area_trends.llm.language_id import fold
from area_trends.sources.tables import materialise

#: counting a slice takes about 55 times its memory, scoring one about 80 times
COUNTED_BYTES = 2_000_000
SCORED_BYTES = 1_000_000
#: windows that are broadcast, the most frequent ones; other windows are joined
MAX_NODES = 1_000_000
#: words with more than this part of all tokens are broadcast; there are at most so many
FREQUENT = 400_000
WORD, WINDOW = 0, 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: the token after the last word of each text: no word has this number
END = 0


def words_of(text: bytes) -> np.ndarray:
    """The words between ASCII white space, as 64-bit hashes."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def tokens(values: list[bytes]) -> list[np.ndarray]:
    """The words of each text and END; a long text is gone through in parts."""
    return [
        np.r_[words_of(v), END]
        if len(v) <= COUNTED_BYTES
        else np.r_[*map(words_of, text_parts(v, SPACE, COUNTED_BYTES)), END]
        for v in values
    ]


def lowered(values: list[str]) -> list[bytes]:
    return [v.encode("utf-8", "replace").lower() for v in values]


def counts_of(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(columns[0]), kind, np.int8)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (kinds, *columns)], ["kind", "key", "n", "everywhere"])


def counting(batches):
    """Rows (kind, key, n, everywhere): words and windows with their counts in learned and in all texts."""
    forget_caches("lm")
    for batch in batches:
        for part in slices(batch, "text", COUNTED_BYTES):
            values = lowered(part.column("text").to_pylist())
            learned = np.array(part.column("learned").to_pylist(), bool)
            numbers = tokens(values)
            keys, place = np.unique(np.concatenate(numbers), return_inverse=True)
            weight = np.repeat(learned, [len(n) for n in numbers])
            everywhere = np.bincount(place, minlength=len(keys))
            counted = np.bincount(place, weights=weight, minlength=len(keys)).astype(np.int64)
            yield counts_of(WORD, keys, counted, everywhere)
            for windows, sizes in window_parts(values, COUNTED_BYTES):
                marked, seen = np.unique(windows << np.uint64(1) | np.repeat(learned, sizes), return_counts=True)
                found = marked >> np.uint64(1)
                first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                times, seen = (np.add.reduceat(c, first) for c in (np.where(marked & np.uint64(1), seen, 0), seen))
                yield counts_of(WINDOW, found[first].astype(np.int64), times, seen)


def least_frequent(sizes: Iterable[tuple[int, int]], most: int) -> int:
    """The smallest size of which, with all larger ones, there are at most `most`; sizes come with their numbers."""
    least, held = np.iinfo(np.int32).max, 0
    for size, count in sorted(sizes, reverse=True):
        held += count
        if held > most:
            break
        least = size
    return int(least)


def rare_tokens(numbers: list[np.ndarray], hit: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """The tokens of each text that are not marked, once each, and their numbers."""
    some, times = [], []
    for known, tokens in zip(np.split(hit, ends[:-1]), numbers, strict=True):
        distinct, count = np.unique(tokens[~known], return_counts=True)
        some.append(distinct)
        times.append(count)
    return [pa.array(x, pa.list_(pa.int64())) for x in (some, times)]


def scoring(version: str, model, frequent) -> Callable:
    """Adds the score of the broadcast windows, the base's parts of frequent words, and what is still to be joined."""

    def run(batches):
        scorer = worker_cache("lm scorer", lambda: Scorer(*model.value), version)
        keys, logs = frequent.value
        for batch in batches:
            for part in slices(batch, "text", SCORED_BYTES):
                values = lowered(part.column("text").to_pylist())
                columns = {n: part.column(n) for n in part.schema.names if n != "text"}
                score, rare, held = np.zeros(len(values)), [], np.zeros(len(values), np.int64)
                for windows, sizes in window_parts(values, SCORED_BYTES):
                    ends = np.cumsum(sizes)
                    found, missing = scorer.log10(windows)
                    score += np.add.reduceat(found, ends - sizes)
                    rare.append(windows[missing].astype(np.int64))
                    held += np.diff(np.searchsorted(missing, np.r_[0, ends]))
                columns["score"] = pa.array(score)
                offsets = np.r_[0, np.cumsum(held)].astype(np.int32)
                columns["rare_windows"] = pa.ListArray.from_arrays(offsets, np.concatenate(rare))
                numbers = tokens(values)
                ends = np.cumsum([len(n) for n in numbers])
                owner = np.repeat(np.arange(len(numbers)), np.diff(np.r_[0, ends]))
                flat = np.concatenate(numbers)
                at = np.searchsorted(keys, flat)
                hit = keys[at] == flat
                value = np.where(hit, logs[at], 0.0)
                columns["n_bytes"] = pa.array([len(v) for v in values], pa.int64())
                columns["n_tokens"] = pa.array(np.diff(np.r_[0, ends]))
                columns["known"] = pa.array(np.bincount(owner, value > 0, len(numbers)).astype(np.int64))
                columns["total"] = pa.array(np.bincount(owner, value, len(numbers)))
                columns["rare"], columns["times"] = rare_tokens(numbers, hit, ends)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def lm_scores(docs: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte of each document.

    Learns from the documents that are not held out (fold 2 of 7 is; a null doc_id is
    neither), over whole texts with A-Z in lower case. score is the log10 probability of
    the text's bytes and its end under context-tree weighting; bits_per_byte is its code
    length over n_bytes + 1. base_score is that of its words and end under smoothed
    counts. Null is read as the empty text. Words are told apart by 64-bit hashes.
    Repeated rows are counted and scored one by one, other columns are ignored. Each different
    window (a byte after its context) is scored once. At most `max_nodes` of them, the most
    frequent ones, are broadcast; the other ones in a text are joined, so the texts are gone through
    once to learn and once to score.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold(docs, 7) == 2, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs.select("doc_id", "text", held.alias("held_out")), "held_out")
    rows = rows.withColumn("learned", ~F.col("held_out") & F.col("doc_id").isNotNull())
    counts = materialise(
        rows.select("text", "learned")
        .mapInArrow(counting, "kind byte, key long, n long, everywhere long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere")),
        "corpus_counts",
    )
    windows = counts.where(F.col("kind") == WINDOW)
    words = counts.where(F.col("kind") == WORD)
    logs = weigh(windows.select(F.col("key").alias("window"), "n", "everywhere"))
    # to the nearest tenth: some hundred sizes at most
    logs = logs.withColumn("size", F.floor(F.log2("everywhere") * 8).cast("int"))
    least = least_frequent(logs.groupBy("size").count().collect(), max_nodes)
    table = logs.where(F.col("size") >= least).select("window", "log", "size").toArrow().sort_by("window")
    model = [c.to_numpy() for c in table.columns]
    model = spark.sparkContext.broadcast(
        (model[0].view(np.uint64), model[1], np.argsort(model[2], kind="stable").astype(np.int32))
    )
    n, tokens, distinct = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("everywhere"), F.lit(0)), F.count_if(F.col("n") > 0)
    ).first()
    is_frequent = F.col("everywhere") * FREQUENT > tokens
    table = words.where(is_frequent).select("key", "n").orderBy("key").toArrow()
    last = np.iinfo(np.int64).max
    frequent = spark.sparkContext.broadcast(
        (np.r_[table.column("key").to_numpy(), last], np.r_[np.log10(table.column("n").to_numpy() + 1.0), 0.0])
    )

    scored = materialise(
        rows.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
            scoring(uuid.uuid4().hex, model, frequent),
            f"doc_id {kind}, held_out boolean, row long, score double, rare_windows array<long>, n_bytes long, "
            "n_tokens long, known long, total double, rare array<long>, times array<long>",
        ),
        "scores",
    )
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("pair"))
    rare_words = (
        pairs.select("row", F.col("pair.rare").alias("key"), F.col("pair.times").alias("times"))
        .join(words.where(~is_frequent & (F.col("n") > 0)).select("key", "n"), "key")
        .select("row", "times", (F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("base"), F.lit(0.0).alias("log"))
    )
    rare_windows = (
        scored.select("row", F.explode("rare_windows").alias("window"))
        .join(logs.where(F.col("size") < least).select("window", "log"), "window")
        .select("row", F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("base"), "log")
    )
    rest = (
        rare_words.union(rare_windows)
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum("base").alias("rest"), F.sum("log").alias("unusual"))
    )
    score = F.col("score") + F.coalesce("unusual", F.lit(0.0))
    share = F.lit(float(np.log10(n + distinct + 1.0)))
    bits = -score * float(np.log2(10)) / (F.col("n_bytes") + 1)
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * share).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        bits.alias("bits_per_byte"),
    )
