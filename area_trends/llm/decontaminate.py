"""Benchmark decontamination: an FM-index per shard of texts, searched for test phrases."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from area_trends.llm.common import forget_caches, slices, text_of, texts
from area_trends.llm.fm_index import FMIndex
from area_trends.sources.tables import materialise

WINDOW = 10
SHARD_BYTES = 2_500_000
#: most bytes of windows that are searched, and broadcast, at a time
BLOCK_BYTES = 32_000_000

#: bytes of a text: digits, lower-cased letters and bytes above ASCII stay, all else is a space
KEPT = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(KEPT).split()


def cut_windows(size: int) -> Callable:
    def run(batches):
        for batch in batches:
            items, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                for i in range(max(len(words) - size, 0) + 1 if words else 0):
                    items.append(row)
                    found.append(b" ".join(words[i : i + size]).decode())
            chosen = batch.column("item_id").take(pa.array(items, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen, pa.array(found, pa.string())], ["item_id", "phrase"])

    return run


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, phrase, phrase_id: the runs of `size` words of each item (all, if fewer)."""
    rows = items.select("item_id", text_of(items).alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(cut_windows(size), f"item_id {kind}, phrase string").distinct()
    return found.withColumn("phrase_id", F.xxhash64("phrase"))


class Phrases:
    """One block of phrases as rows of word numbers; words of no phrase share number 1."""

    def __init__(self, rows: list[tuple[int, str]]):
        split = [phrase.encode().split(b" ") for _, phrase in rows]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.number: dict[bytes, int] = {}
        for words in split:
            for word in words:
                self.number.setdefault(word, len(self.number) + 2)
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.words = np.zeros((len(split), max(map(len, split), default=0)), np.int64)
        for row, words in enumerate(split):
            self.words[row, : len(words)] = [self.number[w] for w in words]

    def find(self, values: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text: its words, the phrases in it and a mark for each word hit."""
        look_up = self.number.get
        numbered = [
            np.fromiter((look_up(w, 1) for w in words), np.int64, len(words))
            for words in map(words_of, values)
        ]
        ends = np.cumsum([0, *[len(n) + 1 for n in numbered]])
        index = FMIndex(np.concatenate([x for n in numbered for x in (n, [0])]), len(self.number) + 1)
        phrase, at = index.search(self.words, self.lengths)
        cover = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.lengths[phrase], -1)
        hit = np.cumsum(cover) > 0
        text = np.searchsorted(ends, at, side="right") - 1
        pairs = np.unique(np.stack([text, phrase]), axis=1)
        bounds = np.searchsorted(pairs[0], np.arange(len(values) + 1))
        for i, words in enumerate(numbered):
            yield len(words), self.ids[pairs[1, bounds[i] : bounds[i + 1]]], hit[ends[i] : ends[i] + len(words)]


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of marks."""
    step = np.diff(np.r_[0, marks.astype(np.int8), 0])
    return list(zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist(), strict=True))


def marking(held) -> Callable:
    def run(batches):
        forget_caches("decontaminate")
        phrases = Phrases(held.value)
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                values = part.column("text").to_pylist()
                sizes, found, hits = [], [], []
                before = zip(part.column("phrases").to_pylist(), part.column("hits").to_pylist(), strict=True)
                for (n, ids, hit), (old_ids, old_hits) in zip(phrases.find(values), before, strict=True):
                    for span in old_hits:
                        hit[span["first"] : span["last"] + 1] = True
                    sizes.append(n)
                    found.append(old_ids + ids.tolist())
                    hits.append([{"first": a, "last": b} for a, b in runs(hit)])
                columns = {n: part.column(n) for n in part.schema.names}
                columns["n_words"] = pa.array(sizes, pa.int64())
                columns["phrases"] = pa.array(found, part.schema.field("phrases").type)
                columns["hits"] = pa.array(hits, part.schema.field("hits").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def find_phrases(
    rows: DataFrame,
    windows: DataFrame,
    block_bytes: int = BLOCK_BYTES,
    then: Callable | None = None,
    then_schema: str = "",
) -> DataFrame:
    """Adds n_words, phrases (ids found) and hits (runs of words in an occurrence) to rows.

    `rows` holds text without null, and none of these names. The phrases are searched in
    blocks of about `block_bytes`, dealt by their hash; each block is broadcast and the
    texts are gone through once per block. What a task holds is an index of
    `SHARD_BYTES` of text, or of one longer text. `then` maps the batches of the last block
    on, to `then_schema`, in the same Python worker, so a task needs one.
    """
    distinct = materialise(windows.select("phrase_id", "phrase").distinct(), "phrases")
    total = distinct.agg(F.sum(F.octet_length("phrase") + 64)).first()[0] or 0
    blocks = total // block_bytes + 1
    found = rows.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "phrases": F.array().cast("array<bigint>"),
            "hits": F.array().cast("array<struct<first:int,last:int>>"),
        }
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    for block in range(blocks):
        chosen = distinct.where(F.pmod("phrase_id", F.lit(blocks)) == block).collect()
        held = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in chosen])
        if block + 1 < blocks:
            found = materialise(found.mapInArrow(marking(held), schema), "phrase_hits")
        elif then is None:
            found = found.mapInArrow(marking(held), schema)
        else:
            found = found.mapInArrow(followed(marking(held), then), then_schema)
    return found


def followed(first: Callable, then: Callable) -> Callable:
    return lambda batches: then(first(batches))


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    Words are runs of digits, letters (A-Z in lower case) and characters above ASCII. A
    word is hit if it lies in an occurrence of a window of any item (item_id, text):
    `size` consecutive words, or all words of a shorter item; an item without words has
    no window. n_items counts the items with such a window; their ids sorted as strings,
    joined by commas, are digested. Null and empty texts have no words. Repeated rows are
    judged one by one; other columns are ignored.
    """
    windows = materialise(item_windows(items, size), "item_windows")
    found = materialise(
        find_phrases(texts(docs), windows, block_bytes).drop("text").withColumn("_row", F.monotonically_increasing_id()),
        "document_hits",
    )
    named = (
        found.select("_row", F.explode("phrases").alias("phrase_id"))
        .join(windows.select("phrase_id", F.col("item_id").cast("string").alias("item")), "phrase_id")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    held = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.join(named, "_row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(held).cast("long").alias("n_items"),
        F.sha2(F.array_join(held, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(batches):
    for batch in batches:
        values = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            if text and spans:
                words = [m.span() for m in WORD.finditer(text)]
                kept, at = [], 0
                for span in spans:
                    kept.append(text[at : words[span["first"]][0]])
                    at = words[span["last"]][1]
                text = "".join([*kept, text[at:]])
            values.append(text)
        names = [n for n in batch.schema.names if n not in ("_text", "hits", "text", "n_words", "phrases")]
        columns = [batch.column(n) for n in names] + [pa.array(values, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "_text"])


def remove_contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without the words of benchmark occurrences; all rows stay.

    Adjacent and overlapping occurrences are merged to one span, which is cut from the
    text from its first word to its last. n_chars, where there is such a column, follows
    the new text; a null text stays null, other columns stay as they are.
    """
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    rows = held.withColumns({"text": F.coalesce(text, F.lit("")), "_text": F.col(text)}).drop(text)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_text", "text")]
    schema = ", ".join([*kinds, "_text string"])
    cut = find_phrases(rows, item_windows(items, size), then=cut_spans, then_schema=schema)
    out = []
    for i, name in enumerate(docs.columns):
        value = F.col("_text") if name == "text" else F.col(f"c{i}")
        if name == "n_chars":
            value = F.when(F.col("_text").isNull(), value).otherwise(
                F.char_length("_text").cast(docs.schema[name].dataType)
            )
        out.append(value.alias(name))
    return cut.select(*out)
