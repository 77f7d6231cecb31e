"""Several spells of follow-up per person: their union, the events inside, person-months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.dates import day_literal, month_number
from .cohort import person_months

BIN_DAYS = 365


def closed_spells(spells: DataFrame, study_end: str | None = None) -> DataFrame:
    """Spells with both dates; a missing end becomes `study_end`, and later ends are cut to it.

    Spells without a start, without an end (if there is no `study_end`), or that end before they
    start hold no day and are left out.
    """
    if study_end is not None:
        last = day_literal(study_end)
        spells = spells.withColumn("end_date", F.least(F.coalesce("end_date", last), last))
    return spells.where(F.col("start_date") <= F.col("end_date"))


def union_spells(
    spells: DataFrame, keys: Sequence[str] = ("pid",), study_end: str | None = None, gap_days: int = 0
) -> DataFrame:
    """The union of each key's spells: disjoint spells (keys, start_date, end_date).

    Spells that overlap, nest, repeat or touch (one begins on the day after another ends) become
    one, as do spells with up to `gap_days` days between them.

    Only the longest spell from each day matters, which is a maximum that combines map-side; so the
    sweep over a key sees one row per day of the calendar at most, however many spells the key has.
    The result can be united with later spells and merged again.
    """
    longest = closed_spells(spells, study_end).groupBy(*keys, "start_date").agg(F.max("end_date").alias("end_date"))
    order = W.partitionBy(*keys).orderBy("start_date")
    reached = F.max("end_date").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.coalesce(F.datediff("start_date", reached) > gap_days + 1, F.lit(True))
    numbered = longest.withColumn("opens", apart.cast("int"))
    numbered = numbered.withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # the window and this grouping share their partitioning
    islands = numbered.groupBy(*keys, "island").agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")
    )
    return islands.drop("island")


def _bin(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / days).cast("int")


def spell_join(
    events: DataFrame,
    spells: DataFrame,
    keys: Sequence[str] = ("pid",),
    day: str = "event_date",
    bin_days: int = BIN_DAYS,
) -> DataFrame:
    """Every pair of an event and a spell of its person that holds its day, once.

    A spell is dealt to each bin of `bin_days` that it meets, an event to the one of its day. The
    join is then an equality on person and bin, followed by the exact test: a person's events meet
    the spells of their own time only, and a frequent person is spread over the bins.
    """
    dealt = closed_spells(spells).withColumn(
        "_bin", F.explode(F.sequence(_bin(F.col("start_date"), bin_days), _bin(F.col("end_date"), bin_days)))
    )
    found = events.withColumn("_bin", _bin(F.col(day), bin_days)).join(dealt, [*keys, "_bin"])
    return found.where(F.col(day).between(F.col("start_date"), F.col("end_date"))).drop("_bin")


def events_in_spells(
    events: DataFrame,
    spells: DataFrame,
    keys: Sequence[str] = ("pid",),
    day: str = "event_date",
    study_end: str | None = None,
    bin_days: int = BIN_DAYS,
) -> DataFrame:
    """Each event inside its person's follow-up once, with the start and end of the united spell.

    Spells may overlap, nest, repeat or be split: they are united first, so an event lies in one at
    most and needs no identity of its own; equal events all stay.
    """
    return spell_join(events, union_spells(spells, keys, study_end), keys, day, bin_days)


def spell_person_months(
    spells: DataFrame,
    persons: DataFrame,
    strata: Sequence[str] = ("sex", "ethnicity", "lsoa"),
    study_end: str | None = None,
) -> DataFrame:
    """`person_months` of the union of each person's spells.

    `persons` (pid, dob, strata) has one row per person. Each united spell counts on its start and
    every month after, up to its end; where the next one starts in the last month counted, that
    month counts once, with the age on the earlier day.
    """
    islands = union_spells(spells, ("pid",), study_end)
    start, end = F.col("start_date"), F.col("end_date")
    months = month_number(end) - month_number(start)
    last = month_number(start) + F.when(F.add_months(start, months) <= end, months).otherwise(months - 1)
    before = F.lag("last").over(W.partitionBy("pid").orderBy("start_date"))
    islands = islands.withColumn("last", F.greatest(last, month_number(start)))
    islands = islands.withColumn("skip", F.coalesce((before == month_number(start)).cast("int"), F.lit(0)))
    follow = islands.drop("last").join(persons.select("pid", "dob", *strata), "pid")
    return person_months(follow, strata, skip="skip")
