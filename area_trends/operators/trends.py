"""Smoothing, periods, trends and the tables behind the charts.

A series holds one row per key and month, so every window and group below is
bounded by the number of months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.dates import day_literal, month_from_number, month_number
from ..functions.fixed_values import COUNT_FIRST_MONTH, LABEL_STEP, LABEL_TOP, LABEL_X, PERIOD_BREAKS, PERIOD_LABELS
from ..functions.stats import fit_moments, with_fit
from ..sources.tables import materialise
from .joins import lookup_join
from .quantiles import exact_quantiles

PERIOD = "covid_period"


def rolling_mean(
    rates: DataFrame,
    keys: Sequence[str] = ("area",),
    from_month: str | None = COUNT_FIRST_MONTH,
    rows: int = 3,
) -> DataFrame:
    """Mean of the rate over the last `rows` rows per key; earlier months are cut afterwards.

    Rows, not calendar months: a gap is skipped over, and the first rows of a
    series average fewer values.
    """
    window = W.partitionBy(*keys).orderBy("year_mo").rowsBetween(1 - rows, 0)
    smooth = rates.withColumn("rolling_avg", F.avg("age_standardised_rate").over(window))
    return smooth if from_month is None else smooth.where(F.col("year_mo") >= day_literal(from_month))


def label_periods(
    series: DataFrame,
    breaks: tuple[str, str] = PERIOD_BREAKS,
    labels: tuple[str, str, str] = PERIOD_LABELS,
) -> DataFrame:
    """Adds the period and its order: before the first break, up to and including the second, after."""
    first, second = (day_literal(b) for b in breaks)
    month = F.col("year_mo")
    return series.withColumns(
        {
            PERIOD: F.when(month < first, labels[0])
            .when(month <= second, labels[1])
            .otherwise(labels[2]),
            "period_order": F.when(month < first, 1).when(month <= second, 2).otherwise(3),
        }
    )


def chart_series(
    labelled_rates: DataFrame,
    keys: Sequence[str] = ("area",),
    from_month: str | None = COUNT_FIRST_MONTH,
    breaks: tuple[str, str] = PERIOD_BREAKS,
) -> DataFrame:
    """Rolling mean with period: the frame behind the line, scatter and box charts.

    `first_break` and `second_break` are the dates of the dividing lines; `label_x` and
    `label_y` place a period's label in its facet, as shares of the axes from below left.
    """
    order = F.col("period_order")
    return label_periods(rolling_mean(labelled_rates, keys, from_month), breaks).withColumns(
        {
            "first_break": day_literal(breaks[0]),
            "second_break": day_literal(breaks[1]),
            "label_x": F.lit(LABEL_X),
            "label_y": F.round(F.lit(LABEL_TOP) - F.lit(LABEL_STEP) * (order - 1), 2),
        }
    )


def month_index(series: DataFrame, keys: Sequence[str] = ("area_label",)) -> DataFrame:
    """Adds the months since the first month of the (key, period)."""
    month = month_number(F.col("year_mo"))
    first = F.min(month).over(W.partitionBy(*keys, PERIOD))
    return series.withColumn("month_index", month - first)


def _fits(series: DataFrame, keys: Sequence[str], min_rows: int, y: str) -> DataFrame:
    # The slope does not depend on where the months start counting, so the fit
    # needs one aggregation and no window for the month index.
    moments = fit_moments(month_number(F.col("year_mo")).cast("double"), F.col(y))
    return with_fit(series.groupBy(*keys, PERIOD).agg(*moments).where(F.col("n_obs") >= min_rows))


def trend_coefficients(
    series: DataFrame,
    keys: Sequence[str] = ("area_label",),
    min_rows: int = 3,
    y: str = "rolling_avg",
) -> DataFrame:
    """Slope per month, its standard error and two-sided p, per key and period."""
    return _fits(series, keys, min_rows, y).select(
        *keys, PERIOD, "slope", "se", "p_value", "n_obs"
    )


def trend_line(
    series: DataFrame,
    keys: Sequence[str] = ("area_label",),
    min_rows: int = 3,
    y: str = "rolling_avg",
    z: float = 1.96,
) -> DataFrame:
    """Fitted value per month from a period's first to its last month, with a band.

    The band is the slope's standard error times `z` at every point.
    """
    fits = _fits(series, keys, min_rows, y)
    span = (F.col("_x_max") - F.col("_x_min")).cast("int")
    points = fits.withColumn("month_index", F.explode(F.sequence(F.lit(0), span)))
    fitted = F.col("intercept") + F.col("slope") * F.col("month_index")
    month = (F.col("_x_min") + F.col("month_index")).cast("int")
    return points.select(
        *keys,
        PERIOD,
        "month_index",
        month_from_number(month).alias("year_mo"),
        fitted.alias("fitted"),
        (fitted - z * F.col("se")).alias("slope_se_band_low"),
        (fitted + z * F.col("se")).alias("slope_se_band_high"),
    )


def forest_bound(trends: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row: the largest distance of slope +- se from 0, plus a margin."""
    return trends.agg(
        (
            F.greatest(
                F.abs(F.max(F.col("slope") + F.col("se"))),
                F.abs(F.min(F.col("slope") - F.col("se"))),
            )
            + margin
        ).alias("max_bound")
    )


def forest_table(
    trends: DataFrame,
    key: str = "area_label",
    periods: Sequence[str] = PERIOD_LABELS,
) -> DataFrame:
    """Slope with upper and lower end for every key and period; missing fits stay null."""
    grid = trends.select(key).distinct().withColumn(
        PERIOD, F.explode(F.array(*[F.lit(p) for p in periods]))
    )
    return grid.join(trends, [key, PERIOD], "left").select(
        key,
        PERIOD,
        "slope",
        "se",
        (F.col("slope") + F.col("se")).alias("upper"),
        (F.col("slope") - F.col("se")).alias("lower"),
    )


def heatmap_matrix(
    series: DataFrame,
    keys: Sequence[str] = ("area_label",),
    periods: Sequence[str] = PERIOD_LABELS,
    value: str = "age_standardised_rate",
) -> DataFrame:
    """Mean rate per key, one column per period; periods without rows are null."""
    return series.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(PERIOD) == p, F.col(value))).alias(p) for p in periods]
    )


def box_stats(
    series: DataFrame,
    keys: Sequence[str] = ("area_label",),
    value: str = "age_standardised_rate",
    reach: float = 1.5,
) -> DataFrame:
    """Quartiles, whiskers (extreme values within `reach` IQR) and outlier count per period.

    Groups may be of any size: quartiles are found by counting, whiskers and outliers are
    aggregated beside them. The values are stored first, as they are gone through several times.
    """
    group = [*keys, PERIOD]
    values = materialise(series.select(*group, F.col(f"`{value}`").cast("double").alias("x")), "box_values")
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    stats = exact_quantiles(values, group, "x").select(
        F.struct(*group).alias("_group"),
        q1.alias("q1"),
        median.alias("median"),
        q3.alias("q3"),
        (q1 - reach * (q3 - q1)).alias("low"),
        (q3 + reach * (q3 - q1)).alias("high"),
    )
    held = lookup_join(values.withColumn("_group", F.struct(*group)), stats, "_group", "left")
    inside = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
    return held.groupBy(*group).agg(
        *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def wide_outcomes(
    rates: DataFrame,
    required: Sequence[str],
    optional: Sequence[str] = (),
    keys: Sequence[str] = ("area", "year_mo", "mean_imd", "area_label"),
) -> DataFrame:
    """One column `<measure>_rate` per measure from long rates with a `measure` column.

    Rows need all `required` measures; the `optional` ones appear only where all
    of them are present. One aggregation in place of a chain of joins; like a
    join, it drops rows with a missing key.
    """
    def present(names: Sequence[str]):
        seen = F.lit(True)
        for m in names:
            seen = seen & (F.col(f"_n_{m}") > 0)
        return seen

    names = [*required, *optional]
    rate, measure = F.col("age_standardised_rate"), F.col("measure")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    grouped = rates.where(known & measure.isin(names)).groupBy(*keys).agg(
        *[F.max(F.when(measure == m, rate)).alias(f"_r_{m}") for m in names],
        *[F.count(F.when(measure == m, F.lit(1))).alias(f"_n_{m}") for m in names],
    )
    return grouped.where(present(required)).select(
        *keys,
        *[F.col(f"_r_{m}").alias(f"{m}_rate") for m in required],
        *[F.when(present(optional), F.col(f"_r_{m}")).alias(f"{m}_rate") for m in optional],
    )
