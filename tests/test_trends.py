import pytest
from helpers import d, rows
from pyspark.sql import functions as F

from area_trends.operators import trends

PRE, DURING, POST = "Pre-COVID", "During COVID", "Post-COVID"


def _series(spark, *pairs, area="X"):
    return spark.createDataFrame(
        [(area, d(m), v) for m, v in pairs], "area string, year_mo date, age_standardised_rate double"
    )


def _averages(df):
    return [round(r["rolling_avg"], 6) for r in df.orderBy("year_mo").collect()]


def test_rolling_mean(spark):
    s = _series(spark, ("2018-04-01", 10.0), ("2018-05-01", 20.0), ("2018-06-01", 60.0), ("2018-07-01", 30.0))
    assert _averages(trends.rolling_mean(s)) == [10, 15, 30, 36.666667]


def test_rolling_mean_counts_rows_and_cuts_afterwards(spark):
    s = _series(spark, ("2018-01-01", 10.0), ("2018-02-01", 20.0), ("2018-06-01", 60.0))
    assert _averages(trends.rolling_mean(s, from_month=None)) == [10, 15, 30]
    assert _averages(trends.rolling_mean(s, from_month="2018-04-01")) == [30]


def test_periods(spark):
    s = _series(spark, *[(m, 1.0) for m in ("2020-02-01", "2020-03-01", "2022-05-01", "2022-06-01")])
    found = trends.label_periods(s).orderBy("year_mo").collect()
    assert [r["covid_period"] for r in found] == [PRE, DURING, DURING, POST]
    assert [r["period_order"] for r in found] == [1, 2, 2, 3]


def test_month_index(spark):
    s = trends.label_periods(_series(spark, ("2019-03-01", 1.0), ("2019-04-01", 1.0), ("2019-07-01", 1.0)))
    found = trends.month_index(s, ("area",)).orderBy("year_mo").collect()
    assert [r["month_index"] for r in found] == [0, 1, 4]


def _fitted(spark, *values, start=1):
    pairs = [(f"2019-{start + i:02d}-01", v) for i, v in enumerate(values)]
    s = _series(spark, *pairs).withColumn("rolling_avg", F.col("age_standardised_rate"))
    return trends.label_periods(s)


def test_trend_coefficients(spark):
    r = trends.trend_coefficients(_fitted(spark, 1.0, 2.5, 2.0, 4.0), ("area",)).first()
    assert (round(r["slope"], 6), round(r["se"], 6), round(r["p_value"], 6), r["n_obs"]) == (
        0.85, 0.327872, 0.122124, 4,
    )
    assert trends.trend_coefficients(_fitted(spark, 1.0, 2.0), ("area",)).count() == 0
    assert trends.trend_coefficients(_fitted(spark, 1.0, 2.0), ("area",), min_rows=2).count() == 1


def test_trend_line_covers_gaps(spark):
    s = _series(spark, ("2019-01-01", 1.0), ("2019-02-01", 2.0), ("2019-05-01", 5.0))
    s = trends.label_periods(s.withColumn("rolling_avg", F.col("age_standardised_rate")))
    line = trends.trend_line(s, ("area",)).orderBy("month_index").collect()
    assert [r["year_mo"].month for r in line] == [1, 2, 3, 4, 5]
    assert [round(r["fitted"], 6) for r in line] == [1, 2, 3, 4, 5]
    noisy = trends.trend_line(_fitted(spark, 1.0, 2.5, 2.0, 4.0), ("area",)).orderBy("month_index").first()
    assert noisy["fitted"] == pytest.approx(1.1)
    assert noisy["slope_se_band_high"] - noisy["fitted"] == pytest.approx(1.96 * 0.327872, abs=1e-5)


def test_forest(spark):
    t = spark.createDataFrame(
        [("X", PRE, 0.5, 0.1), ("Y", POST, -0.9, 0.1)],
        "area_label string, covid_period string, slope double, se double",
    )
    assert trends.forest_bound(t).first()[0] == pytest.approx(1.02)
    table = trends.forest_table(t)
    assert table.count() == 6
    assert [r for r in rows(table, "area_label", "covid_period", "slope") if r[2] is not None] == [
        ("X", PRE, 0.5), ("Y", POST, -0.9),
    ]


def test_heatmap_keeps_empty_cells(spark):
    s = trends.label_periods(_series(spark, ("2019-01-01", 1.0), ("2019-02-01", 3.0), ("2023-01-01", 5.0)))
    assert rows(trends.heatmap_matrix(s, ("area",)), "area", f"`{PRE}`", f"`{DURING}`", f"`{POST}`") == [
        ("X", 2.0, None, 5.0)
    ]


def test_box_stats(spark):
    s = _fitted(spark, 1.0, 2.0, 3.0, 4.0, 100.0)
    r = trends.box_stats(s, ("area",)).first()
    assert tuple(r)[2:] == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_wide_outcomes_joins_like_the_chain_of_joins(spark):
    def row(measure, month, value, mean=4.5):
        return (measure, "X", d(month), mean, "X(..)", value)

    data = [
        row("a", "2020-01-01", 1.0), row("b", "2020-01-01", None), row("c", "2020-01-01", 3.0), row("e", "2020-01-01", 4.0),
        row("a", "2020-02-01", 1.0), row("b", "2020-02-01", 2.0), row("c", "2020-02-01", 3.0),
        row("a", "2020-03-01", 1.0),
        row("a", "2020-04-01", 1.0, None), row("b", "2020-04-01", 1.0, None),
    ]
    long = spark.createDataFrame(
        data, "measure string, area string, year_mo date, mean_imd double, area_label string, "
        "age_standardised_rate double",
    )
    found = trends.wide_outcomes(long, ("a", "b"), ("c", "e"))
    assert rows(found, "year_mo", "a_rate", "b_rate", "c_rate", "e_rate") == [
        (d("2020-01-01"), 1.0, None, 3.0, 4.0),
        (d("2020-02-01"), 1.0, 2.0, None, None),
    ]


def test_many_measures_in_one_job_equal_single_runs(spark):
    a = _series(spark, *[(f"2019-{m:02d}-01", float(m % 5)) for m in range(1, 13)]).withColumn("measure", F.lit("a"))
    b = a.withColumns({"measure": F.lit("b"), "age_standardised_rate": F.col("age_standardised_rate") * 2})
    both = trends.chart_series(a.unionByName(b), ("measure", "area"))
    together = trends.trend_coefficients(both, ("measure", "area"))
    alone = trends.trend_coefficients(trends.chart_series(b, ("area",)), ("area",))
    b_row = together.where("measure = 'b'").first()
    assert b_row["slope"] == pytest.approx(alone.first()["slope"])
    assert b_row["p_value"] == pytest.approx(alone.first()["p_value"])


def test_chart_series_places_labels_and_breaks(spark):
    months = [d("2019-11-01"), d("2020-04-01"), d("2022-08-01")]
    labelled = spark.createDataFrame([("a", m, 1.0) for m in months], "area string, year_mo date, age_standardised_rate double")
    found = trends.chart_series(labelled, ("area",), "2019-01-01", ("2020-03-01", "2022-05-01"))
    assert rows(found, "year_mo", "label_x", "label_y") == [(months[0], 0.01, 0.95), (months[1], 0.01, 0.87), (months[2], 0.01, 0.79)]
    assert set(rows(found, "first_break", "second_break")) == {(d("2020-03-01"), d("2022-05-01"))}
