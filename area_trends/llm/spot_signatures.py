"""Document fingerprints from spot signatures: content-word chains after common words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from area_trends.llm.common import slices, texts, worker_cache
from area_trends.llm.jaccard_join import mix, set_components

SLICE_BYTES = 2_000_000
MAX_CACHED = 150_000
CHAIN = 2
#: Common words of four languages; each starts a chain
ANCHORS = (
    "the a an is was "
    "der die das ein ist "
    "le la les un est "
    "el los las una es"
).split()
#: Further common words, which are passed over in chains
PASSED_OVER = (
    "of and to in that it for on with as by at from this be are or "
    "und zu den von mit nicht im dem des auf eine "
    "de des une et en que qui du pour dans au sur "
    "y por del se con para lo su no"
).split()
SPACED = {c: " " for c in range(128) if not chr(c).isalnum()}


class Spots:
    """Signature sets of texts: hashes of each anchor and the content words after it.

    Words are in lower case and end at ASCII punctuation and spaces. The start of a text
    is an anchor too, with as many content words as there are. Content words that no
    chain holds start a chain of their own (the last ones, of what is left), so texts
    without anchors, such as lists or other languages, enter whole. A text of common words
    only has all of them as its one signature, a text without words itself; only the
    empty text has none.
    """

    def __init__(self, chain: int = CHAIN):
        self.chain = chain
        self.known: dict[str, int] = {}
        self.anchors = np.array(sorted(map(self.number, ANCHORS)), np.uint64)
        self.common = np.array(sorted(map(self.number, [*ANCHORS, *PASSED_OVER])), np.uint64)

    @staticmethod
    def number(word: str) -> int:
        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))

    def sets(self, values: list[str]) -> Iterator[np.ndarray]:
        """The sorted distinct 32-bit signatures of each text."""
        split = [v.lower().translate(SPACED).split() for v in values]
        if len(self.known) > MAX_CACHED:
            self.known.clear()
        for word in set().union(*split).difference(self.known):
            self.known[word] = self.number(word)
        look_up = self.known.__getitem__
        for text, listed in zip(values, split, strict=True):
            words = np.fromiter(map(look_up, listed), np.uint64, len(listed))
            yield np.unique(self.signatures(text, words) >> np.uint64(32))

    def signatures(self, text: str, words: np.ndarray) -> np.ndarray:
        common = self.common[np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)] == words
        content = words[~common]
        if not len(content):
            alone = words.tobytes() if len(words) else text.encode("utf-8", "replace")
            return np.array([xxhash.xxh3_64_intdigest(alone)] if alone else [], np.uint64)
        at = np.minimum(np.searchsorted(self.anchors, words), len(self.anchors) - 1)
        anchor = np.flatnonzero(self.anchors[at] == words)
        before = np.cumsum(~common)[anchor]  # content words before each anchor
        whole = before + self.chain <= len(content)
        anchor, before = anchor[whole], before[whole]
        begin = np.r_[0, before]
        held = np.zeros(len(content), bool)
        for k in range(self.chain):
            held[np.minimum(begin + k, len(content) - 1)] = True
        alone = np.flatnonzero(~held)
        found = np.r_[np.uint64(1), words[anchor], np.full(len(alone), 2, np.uint64)]
        first = np.r_[begin, alone]
        for k in range(self.chain):
            place = np.minimum(first + k, len(content) - 1)
            found = mix(found * np.uint64(0x9E3779B97F4A7C15) + content[place])
        return found


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, 0 where it cannot reach `least`; 1 if both are empty.

    The sizes alone bound it, so sets of too different sizes are not compared.
    """
    low, high = sorted((len(a), len(b)))
    if not high:
        return 1.0
    if not low or low < least * high:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    found = shared / (low + high - shared)
    return found if found >= least else 0.0


def written(signatures: np.ndarray) -> str:
    """A fingerprint as text: the signatures in order, eight hexadecimal digits each."""
    return signatures.astype(">u4").tobytes().hex()


def edit(text: str, other: str) -> str:
    """The text with its last third replaced by as much of the start of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def comparing(batches):
    """Compares each row with the one after it in the same bucket; a guest is only compared with."""
    spots = worker_cache("spots", Spots)
    last = None  # doc_id, text, signatures and bucket of the row before
    schema = None
    for batch in batches:
        schema = schema or pa.schema(
            [batch.schema.field("doc_id")]
            + [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
            + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
        )
        for part in slices(batch, "text", SLICE_BYTES):
            rows = part.to_pydict()
            values = rows["text"]
            pairs, edited = [], []
            for row in zip(
                rows["doc_id"], values, spots.sets(values), rows["bucket"], rows["guest"], strict=True
            ):
                if last is not None and last[3] == row[3]:
                    pairs.append((last, row))
                    edited.append(edit(last[1], row[1]))
                last = None if row[4] else row
            out = []
            for (row, after), text, found in zip(pairs, edited, spots.sets(edited), strict=True):
                digest = hashlib.sha256(text.encode()).hexdigest()
                near = likeness(row[2], found), likeness(row[2], after[2])
                out.append((row[0], len(row[1]), digest, written(row[2]), written(found), *near))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )


def fingerprints(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. The edited text is the document with
    its last third replaced by the start of the next one, in descending doc_id; after the
    last comes the first. Null is read as the empty text, whose fingerprint is empty. A null
    doc_id comes last; repeated doc_id are ordered by text. Other columns are ignored.

    The rows are dealt once, to buckets of consecutive doc_id; the highest document of
    each bucket is also sent to the one before it. The driver sees the bounds and the
    highest doc_id of the buckets, a few numbers for each shuffle partition.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = partitions * buckets_per_partition
    shares = [i / number for i in range(1, number)]
    ids = docs.select("doc_id")
    bounds = ids.agg(F.percentile_approx("doc_id", shares, number * 20)).first()[0] if shares else []
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(found: pd.Series) -> pd.Series:
        place = len(bounds) - np.searchsorted(bounds, found.fillna(np.iinfo(np.int64).min).astype(np.int64), "left")
        return pd.Series(place + found.isna(), dtype="int32")

    marked = texts(docs).withColumn("own", bucket_of("doc_id"))
    heads = ids.withColumn("own", bucket_of("doc_id")).groupBy("own").agg(F.max("doc_id").alias("head"))
    heads = sorted(heads.collect())
    rows = [(h["own"], h["head"], heads[i - 1]["own"]) for i, h in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(rows, f"own int, head {kind.simpleString()}, before int"))
    own = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    return (
        marked.join(table, "own")
        .select("doc_id", "text", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
        .select("doc_id", "text", "at.bucket", "at.guest")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(comparing, f"doc_id {kind.simpleString()}, {SCHEMA}")
    )


def near_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_elements, component_id and n_links of documents with like signatures.

    Two documents link when their signature sets share at least `percent` hundredths of
    their union. Sets are partitioned by length: a set is compared only with those of its
    own and the neighbouring partition, and only if one of the signatures of its prefix
    (as many as it may lack, and one) is in theirs.
    """

    def prefix_keys(signatures: np.ndarray) -> np.ndarray:
        size = len(signatures)
        if not size:
            return np.empty(0, np.uint64)
        band = int(np.log(size) / np.log(100 / percent) + 1e-9)
        rare_first = np.sort(mix(signatures))[: size - (size * percent + 99) // 100 + 1]
        salts = mix(np.array([band + 1, band], np.uint64))
        return np.concatenate([mix(rare_first ^ salt) for salt in salts])

    return set_components(docs, "spots", Spots, prefix_keys, percent)
