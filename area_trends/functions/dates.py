"""Month arithmetic and date ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_number(day: Column) -> Column:
    """Months since year 0, so that differences are whole calendar months."""
    return F.year(day) * 12 + F.month(day) - 1


def month_from_number(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))


def day_from_text(text: Column, pattern: str = "yyyyMMdd") -> Column:
    """Date held as text; text that is no date gives null."""
    return F.try_to_date(text, pattern)


def in_open_range(day: Column, after: str | None, before: str | None) -> Column:
    """Both limits excluded; a limit of None does not restrict."""
    inside = F.lit(True)
    if after is not None:
        inside = inside & (day > day_literal(after))
    if before is not None:
        inside = inside & (day < day_literal(before))
    return inside


def day_literal(day: str | dt.date) -> Column:
    """Date literal; text that is no date raises here, not inside a job."""
    return F.lit(day if isinstance(day, dt.date) else dt.date.fromisoformat(day))


def months_between_first_days(first: str, last: str) -> list[dt.date]:
    """First days of the months first..last, both included."""
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    numbers = range(a.year * 12 + a.month - 1, b.year * 12 + b.month)
    return [dt.date(n // 12, n % 12 + 1, 1) for n in numbers]
