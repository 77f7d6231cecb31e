"""Age in years and age bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import CLOSED_BANDS, DAYS_PER_YEAR, OPEN_BANDS


def age_years(on: Column, dob: Column) -> Column:
    """Fractional age: days lived divided by 365.25."""
    return F.datediff(on, dob).cast("double") / F.lit(DAYS_PER_YEAR)


def age_band_open(age: Column, bands=OPEN_BANDS) -> Column:
    """First band whose upper limit lies above the age.

    The first band has no lower limit, so children fall into it; a missing age
    matches no limit and falls into the last band.
    """
    *limited, (last, _) = bands
    (label, upper), *rest = limited
    expr = F.when(age < upper, label)
    for label, upper in rest:
        expr = expr.when(age < upper, label)
    return expr.otherwise(last)


def age_band_closed(age: Column, bands=CLOSED_BANDS, other: str = "Unknown") -> Column:
    """Band with inclusive limits; 39.5 lies between two bands and gives `other`."""
    expr = None
    for label, low, high in bands:
        inside = age >= low if high is None else (age >= low) & (age <= high)
        expr = F.when(inside, label) if expr is None else expr.when(inside, label)
    return expr.otherwise(other)
