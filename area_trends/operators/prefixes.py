"""Codes matched by the longest listed code that they begin with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .joins import lookup_join

MAX_LENGTHS = 64


def code_lengths(codes: DataFrame, code: str = "code") -> list[int]:
    """The lengths of listed codes: the levels of the trie that hold an end."""
    found = codes.where(F.col(code).isNotNull()).select(F.char_length(code).alias("n")).distinct()
    lengths = sorted(r["n"] for r in found.limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"codes have more than {MAX_LENGTHS} different lengths")
    return lengths


def longest_prefixes(used: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """code and listed: the longest listed code that each different code begins with, where there is one.

    Each code looks its beginnings of the listed lengths up, which is one equality join; the longest
    that is found is a maximum per code.
    """
    lengths = code_lengths(codes)
    asked = used.select(F.col(code).alias("code")).where(F.col("code").isNotNull()).distinct()
    n = F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"))
    begun = asked.select("code", n.alias("n")).where(F.char_length("code") >= F.col("n"))
    begun = begun.select("code", "n", F.left(F.col("code"), F.col("n")).alias("listed"))
    found = lookup_join(begun, codes.select(F.col("code").alias("listed")).distinct(), "listed", "left_semi")
    longest = found.groupBy("code").agg(F.max("n").alias("n"))
    return longest.select("code", F.left(F.col("code"), F.col("n")).alias("listed"))


def match_prefixes(
    events: DataFrame,
    codes: DataFrame,
    columns: Sequence[str] = ("subtype",),
    code: str = "code",
    how: str = "inner",
) -> DataFrame:
    """Events with `listed`, the longest listed code that their code begins with, and its columns.

    `codes` holds each code once, with `columns`. So I6391 finds I63, unless I639 or I6391 is
    listed too. With `left`, events whose code begins with no listed one, or that have none, stay
    with nulls. Codes are compared as they stand; an empty listed code matches every code.

    What is matched is the different codes in use, however many events carry them; the
    outcome is looked up like any code list, broadcast up to a checked size.
    """
    found = longest_prefixes(events, codes, code)
    named = found.join(codes.select(F.col("code").alias("listed"), *columns), "listed")
    named = materialise(named.select(F.col("code").alias(code), "listed", *columns), "prefixes")
    return lookup_join(events, named, code, how)


def match_code_lists(
    events: DataFrame,
    code_col: str,
    codes: DataFrame,
    columns: Sequence[str] = ("subtype",),
    sep: str = ",",
    trim: bool = True,
) -> DataFrame:
    """`match_prefixes` for a column of joined codes: one row per event and code that matches."""
    split = events.withColumn("code", F.explode(F.split(code_col, sep))).drop(code_col)
    split = split.withColumn("code", F.trim("code")) if trim else split
    return match_prefixes(split, codes, columns)
