"""Counts by area, month and age band; direct standardisation; deprivation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bands import age_band_open, age_years
from ..functions.dates import day_literal
from ..functions.fixed_values import (
    COUNT_FIRST_MONTH,
    COUNT_LAST_MONTH,
    OPEN_BANDS,
    STANDARD_WEIGHTS,
)


def monthly_counts(events: DataFrame, keys: Sequence[str] = ("event_mo",)) -> DataFrame:
    """Rows per key combination."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def person_day_counts(events: DataFrame) -> DataFrame:
    """Events per person and day, column `n`.

    Put before a join on the person where one person may hold many events: the
    join then carries at most one row per person and day.
    """
    return events.groupBy("pid", "event_date", "event_mo").agg(F.count(F.lit(1)).alias("n"))


def _bands(bands) -> tuple[str, ...]:
    return tuple(label for label, _ in bands)


def band_counts(
    events: DataFrame,
    first_month: str = COUNT_FIRST_MONTH,
    last_month: str = COUNT_LAST_MONTH,
    bands=OPEN_BANDS,
    keys: Sequence[str] = ("area",),
    weight: str | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Events per key and month, one column per age band at the event; absent bands are 0.

    Counts rows with a person; `weight` names a column of pre-counted events to
    sum instead, `distinct` counts each person once per cell. One aggregation with
    a conditional sum per band: no pivot, no job to find the bands.
    """
    inside = F.col("event_mo").between(day_literal(first_month), day_literal(last_month))
    rows = events.where(inside).withColumn(
        "_band", age_band_open(age_years(F.col("event_date"), F.col("dob")), bands)
    )
    keys = [*keys, "event_mo"]
    if distinct:
        rows = rows.where(F.col("pid").isNotNull()).select(*keys, "_band", "pid").distinct()
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    amount = F.when(F.col("pid").isNotNull(), amount)
    return rows.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("_band") == b, amount)), F.lit(0)).alias(b)
            for b in _bands(bands)
        ]
    )


def age_standardise(
    counts: DataFrame,
    population: DataFrame,
    weights: Mapping[str, float] = STANDARD_WEIGHTS,
    per: float = 100_000,
    complete: bool = False,
    require_unit_sum: bool = True,
) -> DataFrame:
    """Directly standardised rate per area and month.

    `counts` holds area, event_mo and a column per band; `population` holds area,
    year_mo and the same columns. Area-months without a population are dropped,
    and an empty or missing band makes the rate null. With `complete`, months
    that have a population but no event get the rate 0 (counts must then hold no
    keys beyond area and month).
    """
    if require_unit_sum and abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights add up to {sum(weights.values())}, not 1")
    extra = [c for c in counts.columns if c not in weights and c not in ("area", "event_mo")]
    if complete and extra:
        raise ValueError(f"complete months need counts without the keys {extra}")
    people = population.select(
        "area", "year_mo", *[F.col(f"`{b}`").alias(f"_pop_{b}") for b in weights]
    )
    cases = counts.withColumnRenamed("event_mo", "year_mo")
    joined = people.join(cases, ["area", "year_mo"], "left" if complete else "inner")

    def part(band: str, weight: float) -> Column:
        n = F.col(f"`{band}`")
        n = F.coalesce(n, F.lit(0)) if complete else n
        share = F.try_divide(n.cast("double"), F.col(f"`_pop_{band}`").cast("double"))
        return share * float(per) * float(weight)

    first, *rest = [part(b, w) for b, w in weights.items()]
    rate = first
    for term in rest:
        rate = rate + term
    return joined.select("area", "year_mo", *extra, rate.alias("age_standardised_rate"))


def area_deprivation(cohort: DataFrame, decile: str = "imd10") -> DataFrame:
    """Mean and population standard deviation of the decile per area, two decimals."""
    return cohort.groupBy("area").agg(
        F.round(F.avg(decile), 2).alias("mean_imd"),
        F.round(F.stddev_pop(decile), 2).alias("sd_imd"),
    )


def attach_deprivation(rates: DataFrame, deprivation: DataFrame) -> DataFrame:
    """Adds mean, sd and the area label; areas without a score keep an empty mean."""
    label = F.concat_ws(
        "", F.col("area"), F.lit("(Mean IMD Decile:"), F.col("mean_imd").cast("string"), F.lit(")")
    )
    return rates.join(deprivation, "area", "left").withColumn("area_label", label)


def label_order(labelled: DataFrame) -> DataFrame:
    """Area labels by ascending mean score, ties by label, with their position.

    Positions are counted per mean first. A mean of deciles with two decimals
    takes at most 901 values, so the only ordering over everything is short, and
    the areas of one mean are numbered among themselves.
    """
    labels = labelled.select("area_label", "mean_imd").dropDuplicates()
    per_mean = labels.groupBy("mean_imd").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("mean_imd").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_mean.select("mean_imd", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("mean_imd").orderBy("area_label"))
    numbered = labels.withColumn("within", within).alias("l")
    same = F.col("l.mean_imd").eqNullSafe(F.col("o.mean_imd"))
    return (
        numbered.join(offsets.alias("o"), same)
        .select(
            "l.area_label",
            "l.mean_imd",
            (F.col("before") + F.col("within")).cast("long").alias("position"),
        )
        .orderBy("position")
    )
