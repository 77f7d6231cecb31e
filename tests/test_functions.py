import datetime as dt
import decimal
import math

import pytest
from helpers import d, rows
from pyspark.sql import functions as F

from area_trends.functions.bands import age_band_closed, age_band_open, age_years
from area_trends.functions.dates import (
    day_from_text,
    in_open_range,
    month_from_number,
    month_number,
    month_start,
    months_between_first_days,
)
from area_trends.functions.fixed_values import STANDARD_WEIGHTS, STROKE_SUBTYPES
from area_trends.functions.stats import fit_moments, two_sided_t_tail, with_fit


def test_bands(spark):
    ages = spark.createDataFrame([(17.9,), (39.5,), (40.0,), (80.0,), (None,)], "age double")
    found = ages.select(
        "age",
        age_band_open(F.col("age")).alias("open"),
        age_band_closed(F.col("age")).alias("closed"),
    ).collect()
    assert [tuple(r) for r in found] == [
        (17.9, "18-39", "Unknown"),
        (39.5, "18-39", "Unknown"),
        (40.0, "40-59", "40-59"),
        (80.0, "80+", "80+"),
        (None, "80+", "Unknown"),
    ]


def test_age_is_days_over_365_25(spark):
    df = spark.createDataFrame([(d("1980-01-01"), d("2020-01-01"))], "dob date, day date")
    age = df.select(age_years(F.col("day"), F.col("dob"))).first()[0]
    assert age == (dt.date(2020, 1, 1) - dt.date(1980, 1, 1)).days / 365.25


def test_dates(spark):
    df = spark.createDataFrame([("20180115", d("2020-02-29")), ("20181399", None)], "t string, d date")
    found = df.select(
        day_from_text(F.col("t")).alias("a"),
        month_start(F.col("d")).alias("b"),
        month_from_number(month_number(F.col("d"))).alias("c"),
    ).collect()
    assert tuple(found[0]) == (d("2018-01-15"), d("2020-02-01"), d("2020-02-01"))
    assert found[1]["a"] is None
    assert months_between_first_days("2019-11-01", "2020-02-01") == [
        d("2019-11-01"), d("2019-12-01"), d("2020-01-01"), d("2020-02-01"),
    ]


def test_open_range_excludes_both_limits(spark):
    days = ["2017-03-31", "2017-04-01", "2024-03-31", "2024-04-01"]
    df = spark.createDataFrame([(d(x),) for x in days], "day date")
    kept = df.where(in_open_range(F.col("day"), "2017-03-31", "2024-04-01"))
    assert rows(kept, "day") == [(d("2017-04-01"),), (d("2024-03-31"),)]


def test_a_limit_that_is_no_date_is_refused():
    with pytest.raises(ValueError):
        in_open_range(None, "2018-04-31", None)


def test_t_tail_at_five_percent_points(spark):
    points = [(1, 12.706204736), (2, 4.302652730), (3, 3.182446305), (10, 2.228138852),
              (23, 2.068657610), (24, 2.063898562)]
    df = spark.createDataFrame(points, "df long, t double")
    for r in df.select("df", two_sided_t_tail("t", "df").alias("p")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-9), r


def _fit(spark, pairs):
    df = spark.createDataFrame([(float(x), y) for x, y in enumerate(pairs)], "x double, y double")
    return with_fit(df.agg(*fit_moments(F.col("x"), F.col("y")))).first()


def test_fit(spark):
    r = _fit(spark, [1.0, 2.5, 2.0, 4.0])
    assert r["slope"] == pytest.approx(0.85)
    assert r["intercept"] == pytest.approx(1.1)
    assert r["se"] == pytest.approx(0.327872, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.122124, abs=1e-6)
    assert r["n_obs"] == 4


def test_fit_special_cases(spark):
    flat = _fit(spark, [3.0, 3.0, 3.0])
    assert (flat["slope"], flat["se"], flat["p_value"]) == (0, 0, 1)
    two = _fit(spark, [1.0, 2.0])
    assert (two["slope"], two["se"], two["p_value"]) == (1, 0, 0)
    exact = _fit(spark, [1.0, 3.0, 5.0, 7.0])
    assert exact["slope"] == 2 and exact["p_value"] < 1e-12 and exact["se"] < 1e-7
    gap = _fit(spark, [1.0, None, 3.0])
    assert (gap["slope"], gap["se"], gap["p_value"], gap["n_obs"]) == (None, None, None, 3)


def test_fixed_values():
    assert math.isclose(sum(STANDARD_WEIGHTS.values()), 1, abs_tol=1e-9)
    assert {k: len(v) for k, v in STROKE_SUBTYPES.items()} == {
        "haemorrhagic": 25, "ischaemic": 10, "unspecified": 1,
    }

def _pi():
    """Machin's formula."""

    def arc(n):
        total, term, k = decimal.Decimal(0), decimal.Decimal(1) / n, 0
        while term > decimal.Decimal(10) ** -398:
            total += term / (2 * k + 1) * (-1) ** k
            term /= n * n
            k += 1
        return total

    return 16 * arc(5) - 4 * arc(239)


def _angle(x):
    """Arc tangent by halving the angle and its series."""
    halvings = 0
    while x > decimal.Decimal("0.01"):
        x = x / (1 + (1 + x * x).sqrt())
        halvings += 1
    total, power, k = decimal.Decimal(0), x, 0
    while power > decimal.Decimal(10) ** -398:
        total += power / (2 * k + 1) * (-1) ** k
        power *= x * x
        k += 1
    return total * 2**halvings


def _tail(t, df):
    """Two-sided probability from the finite series with 400 digits."""
    t = decimal.Decimal(t)
    root = (df + t * t).sqrt()
    sin, cos = t / root, decimal.Decimal(df).sqrt() / root
    term, total = decimal.Decimal(1), decimal.Decimal(0)
    if df % 2 == 0:
        for k in range(df // 2):
            term = term if k == 0 else term * cos * cos * (2 * k - 1) / (2 * k)
            total += term
        return 1 - sin * total
    for k in range(1, (df - 1) // 2 + 1):
        term = cos if k == 1 else term * cos * cos * (2 * k - 2) / (2 * k - 1)
        total += term
    return 1 - (_angle(sin / cos) + sin * total) * 2 / _pi()


def test_tail_keeps_its_digits(spark):
    sizes = (1, 2, 3, 4, 7, 10, 23, 50, 101, 200)
    pairs = [(t, n) for n in sizes for t in (0.5, 4.99, 5.01, 12.0, 77.0, 770.0, 1000.0)]
    df = spark.createDataFrame(pairs, "t double, df int")
    with decimal.localcontext() as context:
        context.prec = 400
        for row in df.select("t", "df", two_sided_t_tail("t", "df").alias("p")).collect():
            known = _tail(row["t"], row["df"])
            if known > decimal.Decimal("1e-290"):
                assert abs(decimal.Decimal(row["p"]) / known - 1) < decimal.Decimal("1e-9"), row
