"""Event extraction: code matching, first events, registries, deaths, GP records.

A person may hold a large share of all records. Whatever an operator keeps per
person (first event, one row per day or month) is therefore reduced before the
join on the person, and the reduction starts map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bands import age_band_open, age_years
from ..functions.dates import day_from_text, day_literal, in_open_range, month_start
from ..functions.fixed_values import VALUE_OPTIONAL
from .codelists import literal_map
from .joins import lookup_join, person_join
from .spells import spell_join


def _mentions(text: Column, codes: Sequence[str]) -> Column:
    """True if the text holds one of the codes anywhere: skips most rows before the split."""
    return reduce(lambda a, b: a | b, [text.contains(c) for c in codes])


def match_codes(
    events: DataFrame,
    code_col: str,
    codes: Sequence[str] | DataFrame,
    sep: str = ",",
    trim: bool = False,
    out: str = "code",
) -> DataFrame:
    """One row per listed code in a joined code column.

    Codes are compared as they stand; `trim` removes blanks around them first. The list
    may be a table with a column `code`; an empty list gives no rows.
    """
    if isinstance(codes, DataFrame):
        split = events.withColumn(out, F.explode(F.split(code_col, sep))).drop(code_col)
        split = split.withColumn(out, F.trim(out)) if trim else split
        return lookup_join(split, codes.select(F.col("code").alias(out)).distinct(), out, "left_semi").select(split.columns)
    if not codes:
        return events.withColumn(out, F.lit(None).cast("string")).drop(code_col).where(F.lit(False))
    split = events.where(_mentions(F.col(code_col), codes)).withColumn(
        out, F.explode(F.split(code_col, sep))
    )
    if trim:
        split = split.withColumn(out, F.trim(out))
    return split.where(F.col(out).isin(list(codes))).drop(code_col)


def match_outcomes(
    events: DataFrame,
    code_col: str,
    outcomes: Mapping[str, Sequence[str]],
    sep: str = ",",
) -> DataFrame:
    """`match_codes` for several outcomes in one scan, with the outcome as a column."""
    outcome_of = {code: name for name, codes in outcomes.items() for code in codes}
    matched = match_codes(events, code_col, list(outcome_of), sep)
    return matched.withColumn("outcome", literal_map(outcome_of, F.col("code")))


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])
    found = df.groupBy(*keys).agg(pick(row).alias("_row"))
    return found.select(*keys, "_row.*").select(*[f"`{c}`" for c in df.columns])


def first_event(
    df: DataFrame, keys: Sequence[str] = ("pid",), order: Sequence[str] = ("event_date",)
) -> DataFrame:
    """The first row per key; ties go to the smaller remaining columns, left to right.

    A minimum over whole rows: tasks reduce their input to one row per key before
    the shuffle, however many rows a key has. Select the needed columns first, as
    every column takes part in the comparison.
    """
    return _extreme(df, keys, order, F.min)


def latest_per_year(df: DataFrame, date: str = "event_date") -> DataFrame:
    """The latest row per person and calendar year; ties go to the larger other columns."""
    return _extreme(df.withColumn("event_year", F.year(date)), ("pid", "event_year"), (date,), F.max)


def first_per_category(
    labelled: DataFrame, since: str | None = None, order: Sequence[str] = ("event_date",)
) -> DataFrame:
    """First record per person and category; months before `since` are dropped afterwards.

    A person whose first record is earlier than `since` is not incident later.
    """
    first = first_event(labelled, ("pid", "category"), order)
    first = first.withColumn("event_mo", month_start(F.col("event_date")))
    return first if since is None else first.where(F.col("event_mo") >= day_literal(since))


def incident_by_category(
    records: DataFrame,
    categories: DataFrame,
    code: str,
    since: str | None = None,
    order: Sequence[str] = ("event_date",),
) -> DataFrame:
    """`first_per_category` of records that get their category from a code list."""
    return first_per_category(lookup_join(records, categories, code), since, order)


def _registry_rows(
    records: DataFrame, after: str | None, before: str | None, dedupe: str | None
) -> DataFrame:
    """Rows with a person inside the range, deduplicated, before any join."""
    if dedupe not in ("day", "month", None):
        raise ValueError(f"unknown dedupe: {dedupe}")
    rows = records.where(F.col("pid").isNotNull())
    rows = rows.where(in_open_range(F.col("event_date"), after, before))
    rows = rows.select("pid", "event_date").withColumn("event_mo", month_start(F.col("event_date")))
    if dedupe == "day":
        return rows.distinct()
    if dedupe == "month":
        return rows.groupBy("pid", "event_mo").agg(F.min("event_date").alias("event_date"))
    return rows


def registry_events(
    records: DataFrame,
    cohort: DataFrame,
    after: str | None = None,
    before: str | None = None,
    dedupe: str | None = "day",
    split_hot: bool = False,
) -> DataFrame:
    """Registry rows of the cohort with their month, inside an open date range.

    `dedupe` keeps one row per person and day, one per person and month (its
    first day), or, with None, every row; see `person_join` for `split_hot`.
    """
    return person_join(_registry_rows(records, after, before, dedupe), cohort, split_hot)


def registry_counts(
    records: DataFrame,
    cohort: DataFrame,
    after: str | None = None,
    before: str | None = None,
    dedupe: str | None = "day",
) -> DataFrame:
    """Monthly count of `registry_events`, without joining single rows.

    Rows are counted per person and month first, so the join and the second sum
    see at most one row per person and month. The cohort holds a person once.
    """
    rows = _registry_rows(records, after, before, dedupe)
    per_person = rows.groupBy("pid", "event_mo").agg(F.count(F.lit(1)).alias("n"))
    kept = per_person.join(cohort.select("pid"), "pid", "left_semi")
    return kept.groupBy("event_mo").agg(F.sum("n").alias("count"))


def registered_deaths(
    deaths: DataFrame,
    cohort: DataFrame,
    since: str,
    date_text: str = "reg_dod",
    split_hot: bool = False,
) -> DataFrame:
    """Deaths of the cohort since a day given, like the column, as yyyyMMdd text."""
    text = F.col(date_text)
    rows = deaths.where(text >= since)
    return person_join(rows, cohort, split_hot).withColumns(
        {
            "event_year": F.substring(text, 1, 4),
            "event_mo": month_start(day_from_text(text)),
            "event_date": day_from_text(text),
        }
    )


def chapter_codes(df: DataFrame, prefix: str = "I", code: str = "code") -> DataFrame:
    """Causes of one chapter: each alternative code once, with its first description."""
    chapter = df.where(F.col(code).startswith(prefix))
    return chapter.groupBy("cause").agg(F.min("description").alias("description"))


def cause_specific(deaths: DataFrame, causes: DataFrame) -> DataFrame:
    """Deaths whose underlying cause is listed, with its description."""
    return lookup_join(deaths, causes, "cause")


def coded_events(
    records: DataFrame,
    cohort: DataFrame,
    codes: DataFrame,
    since: str | None = None,
) -> DataFrame:
    """The first listed record per cohort person and month, from month `since` on."""
    rows = records.select("pid", "event_date", "code")
    return first_per_month(lookup_join(rows, codes, "code"), cohort, since)


def first_per_month(listed: DataFrame, cohort: DataFrame, since: str | None = None) -> DataFrame:
    """`coded_events` of records that are known to be listed."""
    rows = listed.withColumn("event_mo", month_start(F.col("event_date")))
    if since is not None:
        # The first test follows from the second and can reach the scan.
        floor = day_literal(since)
        rows = rows.where((F.col("event_date") >= floor) & (F.col("event_mo") >= floor))
    rows = first_event(rows, ("pid", "event_mo"), ("event_date", "code"))
    return rows.join(cohort.select("pid"), "pid", "left_semi")


def measure_records(
    records: DataFrame,
    codes: DataFrame,
    follow: DataFrame,
    value_optional: Sequence[str] = VALUE_OPTIONAL,
    band_at: str = "index",
    spells: bool = False,
) -> DataFrame:
    """One row per person, measure and day inside the person's follow-up.

    `records` holds pid, event_date, code, value; `codes` holds code, rf; `follow`
    one row per person with start_date, end_date, lsoa, sex, ethnicity, age_gp, or with
    `spells` any number of spells per person, also ones that overlap.
    A record without value counts only for `value_optional` measures. The band is
    the cohort's own (`index`) or that of the age on the day (`event`).
    """
    rows = records.select("pid", "event_date", "code", "value")
    labelled = lookup_join(rows, codes.select("code", "rf"), "code")
    return followed_measures(labelled, follow, value_optional, band_at, spells)


def followed_measures(
    labelled: DataFrame,
    follow: DataFrame,
    value_optional: Sequence[str] = VALUE_OPTIONAL,
    band_at: str = "index",
    spells: bool = False,
) -> DataFrame:
    """`measure_records` of records that carry their measure `rf`.

    A person listed twice in `follow` still has one row per measure and day, that of the smallest
    attributes among the spells that hold the day; picking it needs no further shuffle. With
    `spells` records meet only the spells of their own time (`spell_join`).
    """
    if band_at not in ("index", "event"):
        raise ValueError(f"unknown band_at: {band_at}")
    rows = labelled.where(F.col("value").isNotNull() | F.col("rf").isin(list(value_optional)))
    rows = rows.select("pid", "rf", "event_date").distinct()
    if spells:
        joined = spell_join(rows, follow)
    else:
        joined = rows.join(follow, "pid").where(
            F.col("event_date").between(F.col("start_date"), F.col("end_date"))
        )
    band = F.col("age_gp")
    if band_at == "event":
        band = age_band_open(age_years(F.col("event_date"), F.col("dob")))
    found = joined.select(
        "pid",
        "rf",
        "event_date",
        month_start(F.col("event_date")).alias("test_mo"),
        "lsoa",
        band.alias("age_gp"),
        "sex",
        "ethnicity",
    )
    return _extreme(found, ("pid", "rf", "event_date"), (), F.min)


def measure_counts(records: DataFrame) -> DataFrame:
    """Records per person, measure, month and small area."""
    return records.groupBy("pid", "rf", "test_mo", "lsoa").agg(F.count(F.lit(1)).alias("count"))


def measure_trend(records: DataFrame) -> DataFrame:
    """Records per month and measure, straight from `measure_records`.

    Equal to the sum of `measure_counts`, without its shuffle by person.
    """
    return records.groupBy("test_mo", "rf").agg(F.count(F.lit(1)).alias("total_count"))


def measure_order(trend: DataFrame) -> DataFrame:
    """Measures by descending total. There are as many rows as measures."""
    totals = trend.groupBy("rf").agg(F.sum("total_count").alias("total_count"))
    ranked = W.orderBy(F.desc("total_count"), "rf")
    return totals.withColumn("position", F.row_number().over(ranked)).orderBy("position")
