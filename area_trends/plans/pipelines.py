"""The composed jobs: from events to rates, series and trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.fixed_values import (
    COUNT_FIRST_MONTH,
    COUNT_LAST_MONTH,
    PERIOD_BREAKS,
    STANDARD_WEIGHTS,
)
from ..operators.denominators import monthly_population, population_projection
from ..operators.events import first_event
from ..operators.rates import (
    age_standardise,
    area_deprivation,
    attach_deprivation,
    band_counts,
    person_day_counts,
)
from ..operators.trends import chart_series


def projected_population(history: DataFrame, year: int) -> DataFrame:
    """Monthly denominators of the history and one projected year."""
    return monthly_population(history, population_projection(history, year))


def incident_events(
    events: DataFrame,
    cohort: DataFrame,
    keys: Sequence[str] = ("pid",),
    order: Sequence[str] = ("event_date", "event_id"),
) -> DataFrame:
    """First event per key with the person's attributes.

    A person's events are all in or all out of the cohort, so the first event is
    picked before the join: the join moves one row per key, not every event. A person
    listed twice in the cohort still has one row per key, that of the smallest attributes;
    picking it needs no further shuffle.
    """
    return first_event(first_event(events, keys, order).join(cohort, "pid"), keys, order)


def event_rates(
    incident: DataFrame,
    population: DataFrame,
    first_month: str = COUNT_FIRST_MONTH,
    last_month: str = COUNT_LAST_MONTH,
    keys: Sequence[str] = ("area",),
    weights: Mapping[str, float] = STANDARD_WEIGHTS,
) -> DataFrame:
    """Age-standardised rate of events that carry area and date of birth."""
    counts = band_counts(incident, first_month, last_month, keys=keys)
    return age_standardise(counts, population, weights)


def all_event_rates(
    events: DataFrame,
    cohort: DataFrame,
    population: DataFrame,
    first_month: str = COUNT_FIRST_MONTH,
    last_month: str = COUNT_LAST_MONTH,
) -> DataFrame:
    """As `event_rates`, counting every event of a person, not only the first."""
    daily = person_day_counts(events).join(cohort, "pid")
    counts = band_counts(daily, first_month, last_month, weight="n")
    return age_standardise(counts, population)


def rate_series(
    rates: DataFrame,
    cohort: DataFrame,
    keys: Sequence[str] = ("area_label",),
    from_month: str = COUNT_FIRST_MONTH,
    breaks: tuple[str, str] = PERIOD_BREAKS,
) -> DataFrame:
    """Rates with deprivation label, rolling mean and period."""
    labelled = attach_deprivation(rates, area_deprivation(cohort))
    return chart_series(labelled, keys, from_month, breaks)
