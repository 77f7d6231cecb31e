"""Joins of large fact tables to lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.001


JOIN_TYPES = ("inner", "left", "left_semi", "left_anti")


def table_bytes(df: DataFrame) -> int:
    """Measured size of a lookup: text and binary at their length, nested columns as JSON.

    Other columns count 8 bytes. One distributed aggregation; one number reaches the driver.
    """
    size = F.lit(16)
    for field in df.schema.fields:
        quoted = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(quoted), F.lit(0)) + 8
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(quoted.alias("v")))), F.lit(0)) + 8
        else:
            size = size + 8
    total = df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"]
    return total or 0


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "inner",
    max_bytes: int = MAX_BROADCAST_BYTES,
    known_bytes: int | None = None,
) -> DataFrame:
    """Join facts to a lookup by one key without shuffling the facts if possible.

    Up to `max_bytes` the lookup is broadcast; beyond that `hot_key_join` shuffles both
    sides and keeps frequent keys apart. Both give the same rows for every supported
    type. A caller that knows a bound of the lookup's size gives it as `known_bytes`;
    else the lookup is measured, by a job that runs while the plan is built.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unsupported join type: {how}")
    size = table_bytes(lookup) if known_bytes is None else known_bytes
    if size <= max_bytes:
        return facts.join(F.broadcast(lookup), on, how)
    return hot_key_join(facts, lookup, on, how)


def hot_key_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "inner",
    share: float = HOT_SHARE,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Shuffle join in which no key may bring more than `share` of the facts to a task.

    Keys above that share are counted exactly; there are at most 1 / share of them.
    Their lookup rows are measured and broadcast, and their facts stay where they are; all
    other keys go through an ordinary shuffle join. Where the frequent keys have more than
    `max_bytes` of lookup rows, all keys are shuffled, and adaptive execution splits
    the frequent ones. The counts are exact, so both branches agree on which keys are hot
    when a task is run again. The facts are read three times; materialise them first if
    they are costly to compute.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unsupported join type: {how}")
    counts = facts.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where(F.col("_n") > total * F.lit(share)).select(on)
    hot_lookup = lookup.join(F.broadcast(hot), on, "left_semi")
    if table_bytes(hot_lookup) > max_bytes:
        return facts.join(lookup, on, how)
    hot_rows = facts.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_lookup), on, how)
    other_rows = facts.join(F.broadcast(hot), on, "left_anti").join(lookup, on, how)
    return hot_rows.unionByName(other_rows)


def person_join(facts: DataFrame, persons: DataFrame, split_hot: bool = False) -> DataFrame:
    """Joins single facts to persons, for results that keep every fact.

    Nothing after this join needs the facts arranged by person, so adaptive
    execution may split a frequent person's partition. `split_hot` does the same
    without it: frequent persons, one row each, are broadcast to their facts.
    """
    return hot_key_join(facts, persons, "pid") if split_hot else facts.join(persons, "pid")
