"""Exact deduplication of documents by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from area_trends.llm.common import numbered, place_of, restored, text_of
from area_trends.sources.tables import materialise

LEAST_BYTES = 256
MOST_BYTES = 4096
WIDTH = 2


def byte_class(rest: int) -> str:
    """Bytes of which the last three bits are `rest`."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(rest, 256, 8)) + "]"


#: a chunk ends behind three bytes of these classes, about one place in 512
END = byte_class(3) + byte_class(5) + byte_class(1)


def normalised(text: Column) -> Column:
    """The text without blanks, tabs and line ends."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def chunks(text: Column, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> Column:
    """The bytes of a text, one character each, cut where their content says so.

    A chunk ends at the first `END` from `least` bytes on, after `most` bytes, or with the text;
    so equal texts have equal chunks, and a changed text has new ones near the change only.
    """
    cut = f"(?s).{{{least - 3},{most - 3}}}?{END}|.{{{most}}}|.+"
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(cut), F.lit(0))


def identifier(chunk: Column, width: int) -> list[Column]:
    """The identifier of a chunk: `width` hashes of 64 bits."""
    return [F.xxhash64(F.lit(i), chunk) for i in range(width)]


def shared_identifiers(docs: DataFrame, width: int) -> DataFrame:
    """Identifiers that stand for different chunks; one copy of a chunk is compared per task."""
    names = [f"id{i}" for i in range(width)]
    held = docs.select(F.explode(chunks(normalised(text_of(docs)))).alias("chunk"))
    held = held.select(*[c.alias(n) for c, n in zip(identifier(F.col("chunk"), width), names, strict=True)], "chunk")
    return held.distinct().groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def verified_width(docs: DataFrame, width: int = WIDTH) -> int:
    """The least width from `width` on for which no two chunks of the texts share an identifier."""
    while not shared_identifiers(docs, width).isEmpty():
        width += 1
    return width


def recipes(docs: DataFrame, width: int, *extra: str) -> DataFrame:
    """doc_id, n_chars, text_sha256 and recipe (identifiers of the chunks in order) of each row."""
    texts = docs.select("doc_id", *extra, text_of(docs).alias("text"))
    texts = texts.select("doc_id", *extra, F.char_length("text").alias("n_chars"), normalised(F.col("text")).alias("text"))
    return texts.select(
        "doc_id",
        *extra,
        "n_chars",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.flatten(F.transform(chunks(F.col("text")), lambda c: F.array(*identifier(c, width)))).alias("recipe"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept to written rows (_row, doc_id, n_chars, recipe, ...)."""
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "_row")
    groups = rows.groupBy("recipe").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups.select("recipe", "first.doc_id", "first._row", "group_size"), "recipe_groups")
    groups = groups.toDF("recipe", "keep_id", "_kept_row", "group_size")
    return rows.join(groups, "recipe").withColumn("kept", F.col("_row") == F.col("_kept_row"))


def exact_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.

    Texts are equal when they are after removal of blanks, tabs and line ends; null counts as
    empty, and empty texts are equal. Of equal texts the longest original stays, in code
    points, then the smallest doc_id, null last; of rows that repeat it, one. text_sha256
    digests the text without blanks. Other columns are ignored; an empty table gives no rows.

    Texts are cut into chunks where they are read. Of each chunk one copy per task is
    shuffled, to prove that different chunks have different identifiers (which are
    widened if not); then texts are equal exactly if their recipes are, and only recipes
    are grouped and joined. A group's size and first row combine map-side, and the join to
    its rows is one that adaptive execution splits.
    """
    width = verified_width(docs, width)
    rows = recipes(docs, width).withColumn("_row", F.monotonically_increasing_id())
    found = grouped(materialise(rows, "recipes"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that stay, with all their columns; which ones, says `exact_dedup`."""
    held = numbered(docs)
    read = [F.col(place_of(docs, c)).alias(c) for c in ("doc_id", "text")]
    width = verified_width(docs, width)
    rows = materialise(recipes(held.select("_row", *read), width, "_row"), "recipes")
    kept = grouped(rows).where("kept").select("_row")
    return restored(docs, held.join(kept, "_row", "left_semi"))
