"""Area lookup, cohort, follow-up time and population at risk."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bands import age_band_closed, age_band_open, age_years
from ..functions.dates import day_literal, month_number
from ..functions.fixed_values import DAYS_PER_YEAR, OPEN_BANDS
from .joins import lookup_join


def area_lookup(
    df: DataFrame,
    area_codes: Sequence[str],
    code_col: str = "area_code",
    columns: Sequence[str] = ("lsoa", "area"),
) -> DataFrame:
    """Small areas of the listed districts, each combination once."""
    return df.where(F.col(code_col).isin(list(area_codes))).select(*columns).dropDuplicates()


def build_cohort(
    person: DataFrame,
    areas: DataFrame,
    index_date: str,
    min_age: float = 18,
    max_age: float | None = 112,
    area_prefix: str = "E01",
    deprivation_col: str = "imd10",
    band_rule: str = "closed",
    flag_col: str | None = None,
) -> DataFrame:
    """Adults with known sex, an address in the country and a deprivation score.

    `person` holds pid, dob, sex, ethnicity, lsoa and the deprivation column, one
    row per person; `areas` maps lsoa to area. `flag_col`, if given, must be 1.
    """
    band = {"closed": age_band_closed, "open": age_band_open}[band_rule]
    age = age_years(day_literal(index_date), F.col("dob"))
    kept = (age >= min_age) & F.col("sex").isNotNull() & (F.col("sex") != "I")
    kept = kept & F.col("lsoa").startswith(area_prefix) & F.col(deprivation_col).isNotNull()
    if max_age is not None:
        kept = kept & (age <= max_age)
    if flag_col is not None:
        kept = kept & (F.col(flag_col) == 1)
    adults = person.where(kept).withColumns(
        {
            "ethnicity": F.when(
                F.col("ethnicity").isNull() | (F.col("ethnicity") == "Other ethnic group"),
                "Other/Unknown",
            ).otherwise(F.col("ethnicity")),
            "age_gp": band(age),
        }
    )
    return lookup_join(adults, areas, "lsoa")


def follow_up(
    cohort: DataFrame,
    records: DataFrame,
    study_end: str,
    lookback_days: int = 731,
    min_months: float = 1,
    record_date: str = "record_date",
) -> DataFrame:
    """Adds start_date and end_date; drops persons followed for less than `min_months`.

    The follow-up starts `lookback_days` before a person's first record and ends
    at death (`dod`) or `study_end`. The minimum per person is combined map-side,
    so a person with very many records costs one row per task.
    """
    starts = records.groupBy("pid").agg(
        F.date_sub(F.min(record_date), lookback_days).alias("start_date")
    )
    return (
        cohort.join(starts, "pid")
        .withColumn("end_date", F.coalesce(F.col("dod"), day_literal(study_end)))
        .where(F.months_between("end_date", "start_date") >= min_months)
    )


def _months_until(start: Column, day: Column) -> Column:
    """Smallest k >= 0 with start + k months on or after `day`."""
    k = month_number(day) - month_number(start)
    k = F.when(F.add_months(start, k) >= day, k).otherwise(k + 1)
    return F.greatest(k, F.lit(0))


def person_months(
    follow: DataFrame,
    strata: Sequence[str] = ("sex", "ethnicity", "lsoa"),
    bands=OPEN_BANDS,
    skip: str | None = None,
) -> DataFrame:
    """Persons under follow-up per year, month, age band and stratum.

    A person counts on start_date, start_date + 1 month, ... up to end_date, in
    the band of the age on that day. Instead of one row per person and month, a
    person yields +1 where a band is entered and -1 where it is left (at most two
    rows per band); a running sum per stratum restores the monthly counts. `skip` names a
    column with the number of first months that do not count.
    """
    start, end, dob = F.col("start_date"), F.col("end_date"), F.col("dob")
    last = month_number(end) - month_number(start)
    spans = follow.select(
        *strata,
        "start_date",
        "dob",
        (F.lit(0) if skip is None else F.col(skip)).alias("skip"),
        month_number(start).alias("first"),
        F.when(F.add_months(start, last) <= end, last + 1).otherwise(last).alias("months"),
    ).where(F.col("months") > 0)

    # Month in which each band is entered; without a date of birth the last band
    # holds throughout.
    labels = [label for label, _ in bands]
    entered = {"enter_0": F.col("skip")}
    for i, (_, upper) in enumerate(bands[:-1], 1):
        birthday = F.date_add(dob, math.ceil(upper * DAYS_PER_YEAR))
        reached = F.coalesce(_months_until(start, birthday), F.lit(0))
        entered[f"enter_{i}"] = F.least(F.greatest(reached, F.col("skip")), F.col("months"))
    runs = spans.select(*strata, "first", "months", *[c.alias(n) for n, c in entered.items()])
    edges = [F.col(n) for n in entered] + [F.col("months")]
    runs = runs.select(
        *strata,
        "first",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(b).alias("age_gp"), e.alias("enter"), l.alias("leave"))
                    for b, e, l in zip(labels, edges[:-1], edges[1:])
                ]
            )
        ),
    ).where(F.col("enter") < F.col("leave"))
    steps = F.array(
        F.struct((F.col("first") + F.col("enter")).alias("ym"), F.lit(1).alias("step")),
        F.struct((F.col("first") + F.col("leave")).alias("ym"), F.lit(-1).alias("step")),
    )
    changes = (
        runs.select(*strata, "age_gp", F.inline(steps))
        .groupBy(*strata, "age_gp", "ym")
        .agg(F.sum("step").alias("step"))
    )
    series = W.partitionBy(*strata, "age_gp").orderBy("ym")
    return (
        changes.withColumns(
            {
                "count": F.sum("step").over(series.rowsBetween(W.unboundedPreceding, 0)),
                "next_ym": F.lead("ym").over(series),
            }
        )
        .where(F.col("count") > 0)
        .withColumn("ym", F.explode(F.sequence("ym", F.col("next_ym") - 1)))
        .select(
            F.floor(F.col("ym") / 12).cast("int").alias("year"),
            (F.col("ym") % 12 + 1).cast("int").alias("month"),
            "age_gp",
            *strata,
            "count",
        )
    )
