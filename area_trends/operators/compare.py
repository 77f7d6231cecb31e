"""Reconciliation of sources: monthly counts, and persons."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start


def reconcile(a: DataFrame, b: DataFrame, a_name: str, b_name: str, on: str = "event_mo") -> DataFrame:
    """Both counts and their difference for the months that both sources hold."""
    left = a.select(on, F.col("count").alias(f"{a_name}_count"))
    right = b.select(on, F.col("count").alias(f"{b_name}_count"))
    return left.join(right, on).withColumn(
        "diff", F.col(f"{a_name}_count") - F.col(f"{b_name}_count")
    )


def person_agreement(sources: Mapping[str, DataFrame], within: int = 30) -> DataFrame:
    """One row per person and month that any source holds an event (pid, event_date) in.

    `sources` is the sum of 1, 2, 4, ... for the sources, in their order, that hold the person
    in the month; `in_<name>` says it in words. `days_<a>_<b>` is the least number of days between an event of one
    and one of the other in the month, null if not both hold the person. Events without person or date
    are left out. `within` bounds what is told apart: larger distances are left null.

    Any number of sources takes one aggregation: a month's days are bits of a number per
    source, joined by OR map-side, and distances are read off these numbers.
    """
    names = list(sources)
    tagged = [
        df.where(F.col("pid").isNotNull() & F.col("event_date").isNotNull()).select(
            "pid",
            month_start(F.col("event_date")).alias("event_mo"),
            F.expr("shiftleft(1L, day(event_date))").alias("day"),
            F.lit(i).alias("source"),
        )
        for i, df in enumerate(sources.values())
    ]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    days = rows.groupBy("pid", "event_mo").agg(
        *[F.coalesce(F.bit_or(F.when(F.col("source") == i, F.col("day"))), F.lit(0)).alias(f"_{i}") for i in range(len(names))]
    )
    held = [F.col(f"_{i}") > 0 for i in range(len(names))]
    bits = reduce(lambda a, b: a + b, [h.cast("int") * (1 << i) for i, h in enumerate(held)])
    return days.select(
        "pid",
        "event_mo",
        bits.alias("sources"),
        *[h.alias(f"in_{n}") for n, h in zip(names, held, strict=True)],
        *[
            _nearest(F.col(f"_{a}"), F.col(f"_{b}"), within).alias(f"days_{names[a]}_{names[b]}")
            for a, b in combinations(range(len(names)), 2)
        ],
    )


def _nearest(a: Column, b: Column, within: int) -> Column:
    """The least distance between a bit of one number and a bit of the other."""
    found = F.lit(None).cast("int")
    for d in range(within, -1, -1):
        near = a.bitwiseAND(F.shiftleft(b, d).bitwiseOR(F.shiftright(b, d))) != 0
        found = F.when(near, F.lit(d)).otherwise(found)
    return found


def agreement_by_month(agreement: DataFrame, first: str, second: str, near: int = 7) -> DataFrame:
    """Persons per month that both sources hold, that one holds alone, and how close the events of both are."""
    a, b, days = F.col(f"in_{first}"), F.col(f"in_{second}"), F.col(f"days_{first}_{second}")
    return agreement.where(a | b).groupBy("event_mo").agg(
        F.count_if(a & b).alias("n_both"),
        F.count_if(a & ~b).alias(f"n_only_{first}"),
        F.count_if(b & ~a).alias(f"n_only_{second}"),
        F.count_if(days == 0).alias("n_same_day"),
        F.count_if(days <= near).alias("n_near"),
    )
