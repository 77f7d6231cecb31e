import datetime as dt

import pytest
from helpers import d, rows
from pyspark.sql import functions as F

from area_trends.functions.fixed_values import BAND_LABELS, EUROPEAN_WEIGHTS
from area_trends.operators import matrices, rates
from area_trends.operators.denominators import (
    monthly_population,
    population_projection,
    population_summary,
)

BANDS = ", ".join(f"`{b}` long" for b in BAND_LABELS)
PEOPLE = ", ".join(f"`{b}` double" for b in BAND_LABELS)


def _born(day, age):
    return d(day) - dt.timedelta(days=int(age * 365.25) + 10)


def _events(spark):
    day = "2020-03-05"
    data = [("X", pid, d(day), d("2020-03-01"), _born(day, age)) for pid, age in ((1, 20), (2, 25), (3, 85))]
    data.append(("X", 1, d("2018-03-31"), d("2018-03-01"), _born(day, 20)))
    data.append(("X", 1, d("2024-11-01"), d("2024-11-01"), _born(day, 20)))
    return spark.createDataFrame(data, "area string, pid long, event_date date, event_mo date, dob date")


def test_band_counts(spark):
    found = rates.band_counts(_events(spark))
    assert rows(found, "area", "event_mo", *[f"`{b}`" for b in BAND_LABELS]) == [
        ("X", d("2020-03-01"), 2, 0, 0, 1)
    ]


def test_band_counts_distinct_and_weighted(spark):
    twice = _events(spark).unionByName(_events(spark))
    assert rows(rates.band_counts(twice), "`18-39`", "`80+`") == [(4, 2)]
    assert rows(rates.band_counts(twice, distinct=True), "`18-39`", "`80+`") == [(2, 1)]
    daily = twice.groupBy(*twice.columns).agg(F.count(F.lit(1)).alias("n"))
    assert rows(rates.band_counts(daily, weight="n"), "`18-39`", "`80+`") == [(4, 2)]


def test_person_day_counts_keep_every_event(spark):
    twice = _events(spark).unionByName(_events(spark))
    assert rates.person_day_counts(twice).agg(F.sum("n")).first()[0] == twice.count()


def _counts(spark, *values):
    return spark.createDataFrame([("X", d("2020-03-01"), *values)], f"area string, event_mo date, {BANDS}")


def _population(spark, *values, month="2020-03-01"):
    return spark.createDataFrame([("X", d(month), *values)], f"area string, year_mo date, {PEOPLE}")


def test_age_standardised_rate(spark):
    found = rates.age_standardise(
        _counts(spark, 2, 0, 1, 1), _population(spark, 1000.0, 1000.0, 500.0, 100.0)
    )
    assert found.first()["age_standardised_rate"] == pytest.approx(180.217735, abs=1e-6)


def test_equal_band_rates_give_that_rate(spark):
    found = rates.age_standardise(
        _counts(spark, 5, 10, 20, 1), _population(spark, 500.0, 1000.0, 2000.0, 100.0)
    )
    assert found.first()["age_standardised_rate"] == pytest.approx(1000.0)


@pytest.mark.parametrize("empty", [0.0, None])
def test_empty_band_makes_the_rate_null(spark, empty):
    found = rates.age_standardise(
        _counts(spark, 2, 0, 1, 1), _population(spark, 1000.0, empty, 500.0, 100.0)
    )
    assert found.first()["age_standardised_rate"] is None


def test_complete_months_and_weights(spark):
    people = _population(spark, 1.0, 1.0, 1.0, 1.0).unionByName(
        _population(spark, 1.0, 1.0, 1.0, 1.0, month="2020-04-01")
    )
    counts = _counts(spark, 1, 1, 1, 1)
    assert rates.age_standardise(counts, people).count() == 1
    found = rates.age_standardise(counts, people, complete=True)
    assert [(r[0], round(r[1], 6)) for r in rows(found, "year_mo", "age_standardised_rate")] == [
        (d("2020-03-01"), 100000.0), (d("2020-04-01"), 0.0),
    ]
    with pytest.raises(ValueError):
        rates.age_standardise(counts, people, EUROPEAN_WEIGHTS)
    loose = rates.age_standardise(counts, people, EUROPEAN_WEIGHTS, require_unit_sum=False)
    assert loose.first()["age_standardised_rate"] == pytest.approx(78500.0)
    with pytest.raises(ValueError):
        rates.age_standardise(counts.withColumn("measure", F.lit("m")), people, complete=True)


def test_deprivation_and_labels(spark):
    cohort = spark.createDataFrame([("X", 4), ("X", 5), ("Y", 2), ("Z", 2)], "area string, imd10 int")
    score = rates.area_deprivation(cohort)
    assert ("X", 4.5, 0.5) in rows(score, "area", "mean_imd", "sd_imd")
    series = spark.createDataFrame([("X",), ("Y",), ("Z",), ("Q",)], "area string")
    labelled = rates.attach_deprivation(series, score)
    assert rows(labelled, "area", "area_label") == [
        ("Q", "Q(Mean IMD Decile:)"),
        ("X", "X(Mean IMD Decile:4.5)"),
        ("Y", "Y(Mean IMD Decile:2.0)"),
        ("Z", "Z(Mean IMD Decile:2.0)"),
    ]
    order = rates.label_order(labelled.unionByName(labelled)).collect()
    assert [(r["area_label"][0], r["position"]) for r in order] == [("Q", 1), ("Y", 2), ("Z", 3), ("X", 4)]


def test_projection_continues_the_line(spark):
    data = [("18-39", "X", 2018 + i, 100.0 + 10 * i) for i in range(6)] + [("80+", "X", 2020, 7.0)]
    history = spark.createDataFrame(data, "age_gp string, area string, year int, population double")
    found = population_projection(history, 2024)
    assert [(b, round(p, 6)) for b, p in rows(found, "age_gp", "population")] == [("18-39", 160.0), ("80+", 7.0)]


def test_monthly_population(spark):
    data = [("18-39", 10.0), ("40-59", 20.0), ("60-79", 30.0), ("80", 40.0)]
    history = spark.createDataFrame(
        [("X", 2023, b, p) for b, p in data], "area string, year int, age_gp string, population double"
    )
    projection = history.withColumns({"year": F.lit(2024), "population": F.col("population") + 0.5})
    found = monthly_population(history, projection)
    assert found.count() == 24
    names = [f"`{b}`" for b in BAND_LABELS]
    assert rows(found.where("year_mo = DATE'2023-12-01'"), *names) == [(10.0, 20.0, 30.0, 40.0)]
    assert rows(found.where("year_mo = DATE'2024-01-01'"), *names) == [(11.0, 21.0, 31.0, 41.0)]


def test_population_summary(spark):
    long = spark.createDataFrame(
        [(2018, "18-39", "X", None), (2018, "80+", "X", 3.0), (2018, "80+", "X", 4.0), (2018, None, "X", 5.0)],
        "year int, age_gp string, area string, population double",
    )
    expected = [("18-39", "E1", 0.0), ("80+", "E1", 7.0)]
    assert rows(population_summary(long, {"X": "E1"}), "age_gp", "area_code", "population") == expected
    codes = spark.createDataFrame([("X", "E1")], "area string, area_code string")
    assert rows(population_summary(long, codes), "age_gp", "area_code", "population") == expected


def test_matrices(spark):
    months = [d("2020-01-01"), d("2020-02-01")]
    limits = ("2020-01-01", "2020-02-01")
    counts = spark.createDataFrame(
        [(1, months[0], 150), (2, months[0], 50), (1, d("2021-01-01"), 9), (3, d("2021-01-01"), 9)],
        "pid long, event_mo date, count long",
    )
    persons = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "pid long, lsoa string")
    found = matrices.area_month_matrix(counts, persons, *limits)
    assert rows(found, "lsoa", "`2020-01-01`", "`2020-02-01`") == [("a", 2.0, 0.0), ("b", 0.0, 0.0)]
    events = spark.createDataFrame([("a", months[0]), ("a", months[0]), ("b", months[1])], "area string, event_mo date")
    found = matrices.area_month_counts(events, *limits)
    assert rows(found, "area", "`2020-01-01`", "`2020-02-01`") == [("a", 2, None), ("b", None, 1)]


def test_matrices_hold_every_month_that_occurs(spark):
    events = spark.createDataFrame([("a", d("2019-11-01")), ("b", d("2020-02-01"))], "area string, event_mo date")
    found = matrices.area_month_counts(events)
    assert found.columns == ["area", "2019-11-01", "2019-12-01", "2020-01-01", "2020-02-01"]
    assert rows(found, "area", "`2019-11-01`", "`2020-02-01`") == [("a", 1, None), ("b", None, 1)]
    assert matrices.area_month_counts(events, last="2019-12-01").columns == ["area", "2019-11-01", "2019-12-01"]
    assert matrices.area_month_counts(events.limit(0)).columns == ["area"]
