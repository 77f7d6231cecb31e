"""Token counts of whole texts by rank-synchronous merging of their pre-tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from area_trends.llm import bpe
from area_trends.llm.common import slices, texts, worker_cache

MAX_CACHED = 1_500_000
SLICE_BYTES = 16_000_000


class Counter:
    """Counts tokens of texts; parts met before are looked up.

    Up to `max_cached` parts are kept, after which the store starts anew.
    """

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        self.merges = bpe.Merges(path)
        self.parts = bpe.Parts(self.merges.special)
        self.known: dict[str, int] = {}
        self.max_cached = max_cached

    def learn(self, parts: list[str]) -> None:
        """Adds the counts of new parts."""
        pieces = [self.parts.pattern.findall(p) for p in parts]
        distinct = list(set().union(*pieces))
        count = dict(zip(distinct, bpe.count_symbols(distinct, self.merges).tolist(), strict=True))
        self.known.update((p, sum(map(count.__getitem__, x))) for p, x in zip(parts, pieces, strict=True))
        self.known.update(dict.fromkeys(self.parts.special, 1))

    def count(self, values: list[str]) -> list[int]:
        held = [self.parts.of(text) for text in values]
        if len(self.known) > self.max_cached:
            self.known.clear()
        new = set().union(*held).difference(self.known)
        if new:
            self.learn(list(new))
        return [sum(map(self.known.__getitem__, parts)) for parts in held]


def counting(path: str, max_cached: int) -> Callable:
    def run(batches):
        counter = worker_cache(f"token_counts {path}", lambda: Counter(path, max_cached))
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                counts = counter.count(part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("n_bytes"), pa.array(np.array(counts, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, max_cached: int = MAX_CACHED
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each document.

    `vocabulary` is the path of a byte-level `tokenizers` file, the same on all
    executors. Counts equal the library's without added tokens; special strings inside a
    text count as one token, as is its default. A null or empty text has no bytes and no
    tokens. Repeated rows are counted one by one; other columns are ignored. There is no
    shuffle: a task reads its texts in slices and keeps the counts of at most
    `max_cached` words between them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = (
        texts(docs)
        .withColumn("n_bytes", F.octet_length("text").cast("long"))
        .mapInArrow(counting(vocabulary, max_cached), f"doc_id {kind}, n_bytes long, n_tokens long")
    )
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
