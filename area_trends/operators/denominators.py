"""Population denominators: projection, monthly table, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import BAND_LABELS
from .codelists import literal_map


def population_projection(history: DataFrame, year: int) -> DataFrame:
    """Population per area and band in `year`, on the straight line through the history."""
    x, y = F.col("year").cast("double"), F.col("population").cast("double")
    return (
        history.groupBy("area", "age_gp")
        .agg(
            F.regr_slope(y, x).alias("_slope"),
            F.avg(F.when(y.isNotNull(), x)).alias("_x"),
            F.avg(F.when(x.isNotNull(), y)).alias("_y"),
        )
        .select(
            "area",
            "age_gp",
            F.lit(year).alias("year"),
            # A single year of history is a flat line.
            (F.col("_y") + F.coalesce("_slope", F.lit(0.0)) * (F.lit(float(year)) - F.col("_x")))
            .alias("population"),
        )
    )


def monthly_population(
    history: DataFrame, projection: DataFrame, bands: Sequence[str] = BAND_LABELS
) -> DataFrame:
    """One row per area and month with a column per band, the projection rounded to persons.

    Each year's figure holds for its twelve months. The band `80` is read as `80+`.
    """
    columns = ("area", "year", "age_gp", "population")
    rounded = projection.withColumn("population", F.round("population", 0))
    both = history.select(*columns).unionByName(rounded.select(*columns))
    band = F.when(F.col("age_gp") == "80", "80+").otherwise(F.col("age_gp"))
    wide = both.groupBy("area", "year").agg(
        *[F.max(F.when(band == b, F.col("population").cast("double"))).alias(b) for b in bands]
    )
    return wide.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).select(
        "area",
        "year",
        F.make_date(F.col("year").cast("int"), "month", F.lit(1)).alias("year_mo"),
        *[F.col(f"`{b}`") for b in bands],
    )


def population_summary(long: DataFrame, area_codes: Mapping[str, str] | DataFrame) -> DataFrame:
    """Population per year, band and area with the area's code.

    Rows without a band are dropped; a group of missing values sums to 0.
    `area_codes` is a fixed mapping or a DataFrame (area, area_code).
    """
    sums = (
        long.where(F.col("year").isNotNull() & F.col("age_gp").isNotNull())
        .where(F.col("area").isNotNull())
        .groupBy("year", "age_gp", "area")
        .agg(F.coalesce(F.sum("population"), F.lit(0.0)).alias("population"))
    )
    if isinstance(area_codes, DataFrame):
        coded = sums.join(area_codes, "area", "left")
    else:
        coded = sums.withColumn("area_code", literal_map(area_codes, F.col("area")))
    return coded.select("year", "age_gp", "area", "area_code", "population")
