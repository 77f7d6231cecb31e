"""Area x month matrices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import months_between_first_days


def months_of(rows: DataFrame, first: str | None, last: str | None, month: str = "event_mo") -> list[dt.date]:
    """The months from the first to the last.

    A limit that is not given is the first or last month that occurs, found by one
    aggregation while the plan is built; then no row with a month is lost.
    """
    if first is None or last is None:
        found = rows.agg(F.min(month).alias("first"), F.max(month).alias("last")).first()
        if found["first"] is None:
            return []
        first, last = first or found["first"].isoformat(), last or found["last"].isoformat()
    return months_between_first_days(first, last)


def area_month_matrix(
    counts: DataFrame,
    persons: DataFrame,
    first: str | None = None,
    last: str | None = None,
    scale: float = 100,
    area: str = "lsoa",
) -> DataFrame:
    """Sum of `count` per area, one column per month, 0 where empty, divided by `scale`.

    `counts` (pid, event_mo, count) is summed per person and month before the join
    to `persons` (pid, area). Months outside first..last have no column; without these
    limits the columns reach from the first month that occurs to the last.
    """
    months = months_of(counts, first, last)
    per_person = counts.groupBy("pid", "event_mo").agg(F.sum("count").alias("count"))
    joined = per_person.join(persons.select("pid", area), "pid")
    wide = joined.groupBy(area).pivot("event_mo", months).agg(F.sum("count")).fillna(0)
    names = [c for c in wide.columns if c != area]
    scaled = [(F.col(f"`{c}`") / float(scale)).alias(c) for c in names]
    return wide.select(area, *scaled).orderBy(area)


def area_month_counts(
    events: DataFrame, first: str | None = None, last: str | None = None, area: str = "area"
) -> DataFrame:
    """Events per area, one column per month; empty cells stay null. Limits as above."""
    return events.groupBy(area).pivot("event_mo", months_of(events, first, last)).count()
