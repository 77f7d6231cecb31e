"""Many random groups at once against numpy, pandas and plain Python."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from area_trends.functions.fixed_values import BAND_LABELS
from area_trends.operators import events as ev
from area_trends.operators import rates, trends
from area_trends.operators.denominators import population_projection


def _month(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


@pytest.fixture(scope="module")
def groups():
    """Series of 3 to 60 months with gaps; all before the first break."""
    rng = np.random.default_rng(11)
    found = {}
    for g in range(120):
        n = int(rng.integers(3, 61))
        months = np.sort(rng.choice(120, size=n, replace=False))
        values = rng.normal(50, 10, n) + rng.normal(0, 0.4) * months
        found[f"g{g:03d}"] = (months, values)
    return found


@pytest.fixture(scope="module")
def series(spark, groups):
    data = [(g, _month(int(m)), float(v)) for g, (months, values) in groups.items() for m, v in zip(months, values)]
    df = spark.createDataFrame(data, "area string, year_mo date, age_standardised_rate double")
    return trends.label_periods(df.withColumn("rolling_avg", F.col("age_standardised_rate"))).cache()


def _tail(t, df):
    """P(|T| > t) by integrating the density over the angle atan(t / sqrt(df))."""
    angles = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 200_001)
    density = np.cos(angles) ** (df - 1)
    whole = math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2))
    area = ((density[1:] + density[:-1]) / 2 * np.diff(angles)).sum()
    return 2 * area / whole


def test_fits(series, groups):
    found = {r["area"]: r for r in trends.trend_coefficients(series, ("area",)).collect()}
    assert found.keys() == groups.keys()
    for g, (x, y) in groups.items():
        n = len(x)
        slope, intercept = np.polyfit(x, y, 1)
        residual = y - intercept - slope * x
        se = math.sqrt((residual**2).sum() / (n - 2) / ((x - x.mean()) ** 2).sum())
        r = found[g]
        assert r["n_obs"] == n
        assert r["slope"] == pytest.approx(slope, rel=1e-8, abs=1e-9)
        assert r["se"] == pytest.approx(se, rel=1e-8)
        assert r["p_value"] == pytest.approx(_tail(abs(slope / se), n - 2), rel=1e-5, abs=1e-9)


def test_lines_pass_through_the_fit(series, groups):
    line = trends.trend_line(series, ("area",)).toPandas()
    for g, (x, y) in groups.items():
        slope, intercept = np.polyfit(x, y, 1)
        part = line[line["area"] == g].sort_values("month_index")
        assert len(part) == x.max() - x.min() + 1
        assert list(part["year_mo"])[0] == _month(int(x.min()))
        assert np.allclose(part["fitted"], intercept + slope * (x.min() + part["month_index"]))


def test_rolling_means(series, groups):
    found = trends.rolling_mean(series.drop("rolling_avg"), ("area",), None).toPandas()
    for g, (_, y) in groups.items():
        part = found[found["area"] == g].sort_values("year_mo")
        assert np.allclose(part["rolling_avg"], pd.Series(y).rolling(3, min_periods=1).mean())


def test_boxes(series, groups):
    found = {r["area"]: r for r in trends.box_stats(series, ("area",)).collect()}
    for g, (_, y) in groups.items():
        q1, q2, q3 = np.percentile(y, [25, 50, 75])
        inside = y[(y >= q1 - 1.5 * (q3 - q1)) & (y <= q3 + 1.5 * (q3 - q1))]
        r = found[g]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        assert (r["whisker_low"], r["whisker_high"]) == pytest.approx((inside.min(), inside.max()))
        assert r["n_outliers"] == len(y) - len(inside)


def test_projections(spark):
    rng = np.random.default_rng(3)
    data, expected = [], {}
    for a in range(40):
        years = np.arange(2018, 2024)
        values = rng.uniform(1000, 9000, 6)
        data += [(f"a{a}", "18-39", int(y), float(v)) for y, v in zip(years, values)]
        slope, intercept = np.polyfit(years - 2018, values, 1)
        expected[f"a{a}"] = intercept + slope * 6
    history = spark.createDataFrame(data, "area string, age_gp string, year int, population double")
    for r in population_projection(history, 2024).collect():
        assert r["population"] == pytest.approx(expected[r["area"]], rel=1e-9)


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(20_000).selectExpr(
        "id AS event_id",
        "pmod(hash(id), 700) AS pid",
        "CONCAT('A', pmod(hash(id, 1), 9)) AS area",
        "date_add(DATE'2018-01-01', CAST(pmod(hash(id, 2), 2600) AS INT)) AS event_date",
        "date_add(DATE'1930-01-01', CAST(pmod(hash(id, 3), 25000) AS INT)) AS dob",
    ).withColumn("event_mo", F.trunc("event_date", "month"))


def test_no_event_comes_before_the_first(events):
    first = ev.first_event(events.select("pid", "event_date", "event_id"), order=("event_date", "event_id"))
    frame = events.select("pid", "event_date", "event_id").toPandas().sort_values(["event_date", "event_id"])
    expected = frame.groupby("pid").first().reset_index()[["pid", "event_date", "event_id"]]
    found = first.toPandas().sort_values("pid").reset_index(drop=True)
    pd.testing.assert_frame_equal(found, expected, check_dtype=False)


def test_bands_add_up_to_the_events_in_range(events):
    counts = rates.band_counts(events, "2019-01-01", "2022-06-01")
    sums = counts.agg(*[F.sum(F.col(f"`{b}`")).alias(b) for b in BAND_LABELS]).first()
    inside = events.where("event_mo BETWEEN DATE'2019-01-01' AND DATE'2022-06-01'").count()
    assert sum(sums) == inside


def test_weights_leave_equal_rates_unchanged(events):
    counts = rates.band_counts(events)
    people = counts.withColumnRenamed("event_mo", "year_mo")
    found = rates.age_standardise(counts, people, per=1000)
    full = counts.where(" AND ".join(f"`{b}` > 0" for b in BAND_LABELS)).count()
    values = [r[0] for r in found.select("age_standardised_rate").collect() if r[0] is not None]
    assert len(values) == full and values == pytest.approx([1000.0] * full)
