"""Code lists: assembly, merging, exclusion, subtypes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_map(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed mapping as an expression, null if the key is absent."""
    pairs = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*pairs), key)


def codelist(
    df: DataFrame,
    mapping: Mapping[str, str],
    exclude: Mapping[str, str] | None = None,
    cluster: str = "cluster",
    code: str = "code",
    description: str = "description",
) -> DataFrame:
    """Codes of the mapped clusters with their label `rf`, in one scan.

    `exclude` names, per cluster, a text that rules a description out; in such a
    cluster a missing description is dropped too.
    """
    kept = F.col(cluster).isin(list(mapping))
    for name, text in (exclude or {}).items():
        kept = kept & ((F.col(cluster) != name) | ~F.col(description).contains(text))
    return df.where(kept).select(
        cluster, code, description, literal_map(mapping, F.col(cluster)).alias("rf")
    )


def merge_codelists(*lists: DataFrame) -> DataFrame:
    """One row per code over lists of (code, description); the first text in order is kept."""
    named = [df.toDF("code", "description") for df in lists]
    merged = reduce(lambda a, b: a.unionByName(b), named)
    return merged.groupBy("code").agg(F.min("description").alias("description"))


def codes_excluded(
    df: DataFrame,
    cluster: str,
    other_cluster: str | None = None,
    texts: Sequence[str] = (),
) -> DataFrame:
    """Codes of one cluster, without those of another and those whose description holds a text."""
    kept = df.where(F.col("cluster") == cluster)
    for text in texts:
        kept = kept.where(~F.col("description").contains(text))
    if other_cluster is not None:
        other = df.where(F.col("cluster") == other_cluster).select("code")
        kept = kept.join(other, "code", "left_anti")
    return kept.select("code", "description").dropDuplicates()


def cluster_sizes(df: DataFrame, keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """Rows per cluster, largest first."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_codes"))
    return sizes.orderBy(F.desc("n_codes"), *keys)


def subtype_codes(df: DataFrame, code: str = "code", subtype: str = "subtype") -> DataFrame:
    """Code -> subtype with surrounding blanks removed, each code once."""
    clean = df.select(F.trim(code).alias("code"), F.trim(subtype).alias("subtype"))
    return clean.groupBy("code").agg(F.min("subtype").alias("subtype"))


def subtype_of(code: Column, subtypes: Mapping[str, Sequence[str]]) -> Column:
    """Subtype of a code from a fixed list, null if the code is not listed."""
    return literal_map({c: name for name, codes in subtypes.items() for c in codes}, code)
