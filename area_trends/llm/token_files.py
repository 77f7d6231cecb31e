"""Token ids in ORC files: run-length encoded stripes with row indexes and Bloom filters."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from area_trends.llm import bpe
from area_trends.llm.common import slices, texts, worker_cache
from area_trends.sources.tables import materialise, scratch_folder

MAX_CACHED = 1_000_000
SLICE_BYTES = 1_000_000
STRIPE_BYTES = 16 * 1024 * 1024
ROWS_PER_INDEX = 1000
#: bytes as the characters that stand for them in the vocabulary
SHOWN = {byte: char for char, byte in bpe.printable_bytes().items()}


#: letters of the Latin alphabets: a run of them is one pre-token
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: a word, a word closed by a comma or a full stop, and two words around a line end
WORD, CLOSED, LINES = f"^[{LATIN}]+$", f"^[{LATIN}]+[,.]$", f"^[{LATIN}]+[,.]?\n[{LATIN}]+$"


def matching(parts: list[str], pattern: str) -> tuple[list[str], list[str]]:
    """The parts that a pattern matches, and the others."""
    hit = pa.compute.match_substring_regex(pa.array(parts, pa.large_string()), pattern).to_numpy(zero_copy_only=False)
    return list(compress(parts, hit)), list(compress(parts, ~hit))


class Growing:
    """An integer array that grows at its end."""

    def __init__(self):
        self.held, self.size = np.zeros(1 << 16, np.int32), 0

    def extend(self, values: list[int] | np.ndarray) -> None:
        while self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


class Encoder:
    """Token ids as the library gives them; parts met before are looked up.

    Up to about `max_cached` parts are kept, after which the store starts anew. A word
    closed by a comma or a full stop is looked up without it, and what stands around a line
    end by itself. A word of Latin letters with the space before it, if there is one, is one
    pre-token, which goes to the library's model directly.
    """

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        self.library = Tokenizer.from_file(path)
        self.parts = bpe.Parts(t.content for t in self.library.get_added_tokens_decoder().values())
        self.spaces = re.compile(r" \s")  # which odd spaces begin with or follow, and faster to find
        self.max_cached = max_cached
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str | bytes, int] = {}
        self.ids, self.starts, self.sizes = Growing(), Growing(), Growing()

    def split(self, values: list[str]) -> tuple[list[list[bytes]], pa.Array]:
        """Of each text the parts that stand alone, and the list of words after a space that follow them."""
        alone, rest = [], []
        for text in values:
            odd = self.spaces.search(text) and self.parts.odd_space.search(text)
            if odd or self.parts.cut.search(text):
                alone.append([p.encode() for p in self.parts.of(text)])
                rest.append(None)
            else:
                first, space, after = text.partition(" ")
                alone.append([first.encode()])
                rest.append(after if space else None)
        return alone, pa.compute.split_pattern(pa.array(rest, pa.large_string()), " ")

    def add(self, parts: list[str | bytes]) -> tuple[np.ndarray, list[str | bytes]]:
        """The numbers of distinct parts, and those parts among them that had none before."""
        number = np.fromiter(map(self.numbers.get, parts, repeat(-1)), np.int32, len(parts))
        at = np.flatnonzero(number < 0)
        new = list(map(parts.__getitem__, at.tolist()))
        number[at] = np.arange(len(self.numbers), len(self.numbers) + len(new))
        self.numbers.update(zip(new, number[at].tolist(), strict=True))
        self.starts.extend(np.zeros(len(new), np.int32))
        self.sizes.extend(np.zeros(len(new), np.int32))
        return number, new

    def added(self, parts: Iterable[str | bytes]) -> list[str | bytes]:
        """The different parts that had no number before; they have one now."""
        return self.add(list(dict.fromkeys(parts)))[1]

    def number(self, parts: list[str | bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, parts), np.int32, len(parts))

    def learn(self, alone: Iterable[bytes], words: list[str]) -> np.ndarray:
        """Numbers parts and finds the ids of the new ones; a string is a word after a space, bytes stand alone.

        Returns the numbers of the words, which are distinct.
        """
        number_of_words, new = self.add(words)
        latin, rest = matching(new, WORD)
        closed, rest = matching(rest, CLOSED)
        lines, rest = matching(rest, LINES)
        latin += self.added([c[:-1] for c in closed])
        halves = [line.split("\n") for line in lines]
        joined = matching(self.added([a for a, _ in halves]), CLOSED)
        latin += joined[1] + self.added([c[:-1] for c in joined[0]])
        closed += joined[0]
        ends = [c[-1].encode() for c in closed]
        single = self.added(chain(alone, ends, [b"\n"] if lines else [], [b.encode() for _, b in halves]))
        plain, other = matching([p.decode() for p in single], WORD)
        plain, special = [p for p in plain if p not in self.parts.special], [p for p in plain if p in self.parts.special]
        self.put_words(self.number(latin), [" " + w for w in latin])
        self.put_words(self.number([p.encode() for p in plain]), plain)
        other += special
        number = np.r_[self.number([p.encode() for p in other]), self.number(rest)]
        other += [" " + p for p in rest]
        for i in range(0, len(other), 10_000):
            found = self.library.encode_batch_fast(other[i : i + 10_000], add_special_tokens=False)
            self.put(number[i : i + 10_000], [f.ids for f in found])
        self.put_joined(self.number(closed), [self.number([c[:-1] for c in closed]), self.number(ends)])
        if lines:
            end = np.full(len(lines), self.numbers[b"\n"], np.int32)
            before, after = (self.number(list(x)) for x in ([a for a, _ in halves], [b.encode() for _, b in halves]))
            self.put_joined(self.number(lines), [before, end, after])
        assert self.starts.size == self.sizes.size == len(self.numbers)
        return number_of_words

    def put_words(self, numbers: np.ndarray, words: list[str]) -> None:
        """The ids of words that are one pre-token with the space before them, if there is one."""
        tokenize = self.library.model.tokenize
        for i in range(0, len(words), 10_000):
            shown = "\n".join(words[i : i + 10_000]).encode().decode("latin-1").translate(SHOWN).split(SHOWN[10])
            self.put(numbers[i : i + 10_000], [[token.id for token in tokenize(w)] for w in shown])

    def put(self, numbers: np.ndarray, found: list[list[int]]) -> None:
        size = np.fromiter(map(len, found), np.int32, len(found))
        self.sizes.held[numbers] = size
        self.starts.held[numbers] = self.ids.size + np.cumsum(size) - size
        self.ids.extend(list(chain.from_iterable(found)))

    def put_joined(self, numbers: np.ndarray, parts: list[np.ndarray]) -> None:
        """The ids of parts that are made of others: theirs, one after another."""
        others = np.column_stack(parts).ravel()
        sizes = self.sizes.held[others].astype(np.int64)
        ends = np.cumsum(sizes)
        found = self.ids.held[np.repeat(self.starts.held[others] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        size = sizes.reshape(-1, len(parts)).sum(axis=1)
        self.sizes.held[numbers] = size
        self.starts.held[numbers] = self.ids.size + np.cumsum(size) - size
        self.ids.extend(found)

    def encode(self, values: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by `end_id`, and how many each text has."""
        if len(self.numbers) > self.max_cached:
            self.clear()
        alone, after = self.split(values)
        words = after.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self.learn(chain.from_iterable(alone), known)
        n_alone = np.fromiter(map(len, alone), np.int64, len(alone))
        n_words = pa.compute.fill_null(pa.compute.list_value_length(after), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(n_alone + n_words + 1) - 1
        parts = np.empty(int((n_alone + n_words + 1).sum()), np.int32)
        is_word = np.repeat(np.tile([False, True, False], len(values)), np.c_[n_alone, n_words, np.ones_like(n_alone)].ravel())
        parts[is_word] = number[words.indices.to_numpy()]
        is_word[ends] = True
        parts[~is_word] = self.number(list(chain.from_iterable(alone)))
        parts[ends] = 0
        sizes = self.sizes.held[parts].astype(np.int64)
        sizes[ends] = 1
        before = np.cumsum(sizes) - sizes
        out = self.ids.held[np.repeat(self.starts.held[parts] - before, sizes) + np.arange(sizes.sum())]
        out[before[ends]] = end_id
        return out, np.diff(np.r_[0, before[ends] + 1])


def encoding(path: str, end_id: int, max_cached: int) -> Callable:
    def run(batches):
        encoder = worker_cache(f"token_files {path}", lambda: Encoder(path, max_cached))
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, sizes = encoder.encode(part.column("text").to_pylist(), end_id)
                ends = np.r_[0, np.cumsum(sizes)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                columns = [part.column("doc_id"), np.full(len(sizes), shard, np.int32), start + ends[:-1], lists]
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    ["doc_id", "shard", "shard_start", "ids"],
                )

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 0,
    shards: int | None = None,
    max_cached: int = MAX_CACHED,
) -> None:
    """Writes the token ids of all documents as ORC files in ascending doc_id order.

    Each file holds a range of doc_id in order: doc_id, the file's number (shard), the
    ids before the document in its shard (shard_start), and ids, closed by `end_id`.
    ORC stores them as run-length encoded integers in stripes that are read in parallel,
    with a row index every `ROWS_PER_INDEX` rows and Bloom filters on doc_id, by which
    `read_ids` skips stripes. Null and empty texts have the end id only. Equal doc_id
    are ordered by text, null comes first; other columns are not written.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        texts(docs)
        .repartitionByRange(wanted, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(
            encoding(vocabulary, end_id, max_cached),
            f"doc_id {kind}, shard int, shard_start long, ids array<int>",
        )
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows, or those of a few documents by row indexes and Bloom filters."""
    found = spark.read.orc(path)
    return found if doc_ids is None else found.where(F.col("doc_id").isin(doc_ids))


def digests(batches):
    for batch in batches:
        ids = batch.column("ids")
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        columns = [batch.column(n) for n in ("doc_id", "shard", "shard_start")]
        columns += [pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the written files.

    start counts the ids of all documents before it: those of earlier shards (one number
    per file) and those before it in its own.
    """
    files = read_ids(spark, path)
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = materialise(
        files.mapInArrow(
            digests, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids_crc32 long"
        ),
        "token_digests",
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard")
        .agg(F.sum("n_tokens").alias("held"))
        .select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    )
    return rows.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of all documents to shared scratch space and describes the files."""
    path = scratch_folder(docs.sparkSession, "token_ids")
    write_ids(docs, path, vocabulary, end_id)
    return token_positions(docs.sparkSession, path)
