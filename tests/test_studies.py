"""The studies end to end on tables with the source column names."""

import pytest
from helpers import d, rows
from pyspark.sql import functions as F

from area_trends.functions.fixed_values import LONDON_AREA_CODES, MERSEY_AREA_CODES
from area_trends.operators import events as ev
from area_trends.operators.compare import reconcile
from area_trends.operators.rates import monthly_counts
from area_trends.plans import pipelines, studies


@pytest.fixture(scope="module")
def demographics(spark):
    data = [
        ("p1", d("1950-01-01"), "M", "White", 4, 2, None, "E01A", 1),
        ("p2", d("1990-01-01"), "F", None, 5, 3, d("2024-06-01"), "E01A", 1),
        ("p3", d("1980-01-01"), "F", "White", 1, 1, None, "E01B", 0),
        ("p4", d("2010-01-01"), "F", "White", 1, 1, None, "E01B", 1),
    ]
    return spark.createDataFrame(
        data,
        "person_id string, date_of_birth date, sex string, ethnicity_5_group string, imd_decile int, "
        "imd_quintile int, date_of_death date, lsoa string, in_gdppr int",
    )


@pytest.fixture(scope="module")
def cohort(spark, demographics):
    lookup = spark.createDataFrame(
        [("E01A", "A name", "Barnet", "E09000003"), ("E01A", "A name", "Barnet", "E09000003"),
         ("E01B", "B name", "Brent", "E09000005"), ("E01C", "C name", "Leeds", "E08000035")],
        "LSOA11CD string, LSOA11NM string, LAD13NM string, LAD13CD string",
    )
    return studies.adult_cohort(demographics, lookup)


@pytest.fixture(scope="module")
def admissions(spark):
    return spark.createDataFrame(
        [("p1", d("2019-05-02"), "I10,I63"), ("p1", d("2018-05-02"), "I61"), ("p1", d("2017-03-31"), "I64"),
         ("p2", d("2024-04-01"), "I63"), ("p2", d("2024-04-01"), "I21"), ("p9", d("2019-01-01"), "I63")],
        "PERSON_ID_DEID string, ADMIDATE date, DIAG_3_CONCAT string",
    )


def test_districts():
    assert len(LONDON_AREA_CODES) == 33 and len(MERSEY_AREA_CODES) == 9


def test_cohort(cohort):
    assert rows(cohort, "pid", "area", "age_gp", "ethnicity") == [
        ("p1", "Barnet", "60-79", "White"),
        ("p2", "Barnet", "18-39", "Other/Unknown"),
        ("p3", "Brent", "18-39", "White"),
    ]


def test_first_admissions(admissions, cohort):
    assert rows(studies.strokes(admissions, cohort), "pid", "event_date", "area") == [
        ("p1", d("2018-05-02"), "Barnet")
    ]
    assert rows(studies.heart_attacks(admissions, cohort), "pid", "code") == [("p2", "I21")]


def test_stroke_reconciliation(spark, admissions, cohort):
    archive = spark.createDataFrame(
        [("2024-12-02", "p1", "2018-05-03 10:00:00"), ("2024-12-02", "p1", "2018-05-03 11:00:00"),
         ("2024-12-02", "p3", "2018-05-09 11:00:00"), ("2024-12-02", "p3", "2018-04-30 23:00:00"),
         ("2024-01-01", "p1", "2018-05-03 10:00:00"), ("2024-12-02", None, "2018-05-03 10:00:00")],
        "archived_on string, Person_ID_DEID string, S1FIRSTARRIVALDATETIME string",
    )
    registered = studies.stroke_registry_counts(archive, cohort)
    admitted = monthly_counts(studies.strokes(admissions, cohort))
    assert rows(reconcile(admitted, registered, "admission", "registry"), "event_mo", "diff") == [
        (d("2018-05-01"), -1)
    ]


def test_other_registries(spark, cohort):
    archive = spark.sql(
        "SELECT '2025-04-24' AS archived_on, 'p1' AS `1_03_NHS_NUMBER_DEID`, "
        "TIMESTAMP'2017-04-01 09:00:00' AS ARRIVAL_AT_HOSPITAL"
    )
    assert rows(studies.mi_registry_counts(archive, cohort), "event_mo", "count") == [(d("2017-04-01"), 1)]
    current = spark.createDataFrame(
        [("p1", "2019-01-20 01:00"), ("p1", "2019-02-01 01:00"), ("p1", "2019-02-09 01:00")],
        "NHS_NUMBER_DEID string, ARRIVAL_AT_HOSPITAL string",
    )
    assert rows(studies.current_mi_registry_counts(current, cohort), "event_mo", "count") == [(d("2019-02-01"), 1)]
    onsets = current.toDF("Person_ID_DEID", "S1ONSETDATETIME")
    assert rows(studies.current_stroke_registry_counts(onsets, cohort), "event_mo", "count") == [
        (d("2019-01-01"), 1), (d("2019-02-01"), 2),
    ]


def test_deaths(spark, cohort):
    registered = spark.createDataFrame(
        [("p1", "20190105", "I219", "x"), ("p2", "20240606", "J45", "x"), ("p3", "20171231", "I219", "x")],
        "DEC_CONF_NHS_NUMBER_CLEAN_DEID string, REG_DATE_OF_DEATH string, S_UNDERLYING_COD_ICD10 string, "
        "S_COD_CODE_1 string",
    )
    icd = spark.createDataFrame(
        [("I21.9", "Heart attack", "I219"), ("J45", "Asthma", "J45")], "CODE string, DESCRIPTION string, ALT_CODE string"
    )
    assert rows(studies.deaths(registered, cohort), "pid", "event_mo") == [
        ("p1", d("2019-01-01")), ("p2", d("2024-06-01")),
    ]
    assert rows(studies.cardiac_deaths(registered, icd, cohort), "pid", "description") == [("p1", "Heart attack")]


def test_medications(spark, cohort):
    prescriptions = spark.createDataFrame(
        [("p1", "2019-01-05", "n", "d1", 1.0), ("p1", "2018-01-05", "n", "d2", 1.0), ("p2", "2016-01-05", "n", "d1", 1.0),
         ("p2", "2019-01-05", "n", "d1", 1.0), ("p2", "2019-01-05", "n", "zz", 1.0)],
        "Person_ID_DEID string, ProcessingPeriodDate string, PaidBNFName string, PaidBNFCode string, PaidQuantity double",
    )
    drugs = spark.createDataFrame(
        [("lipid_lowering", "d1"), ("lipid_lowering", "d2")], "key_group string, BNF_PRESENTATION_CODE string"
    )
    found = studies.medications(prescriptions, drugs, cohort)
    assert rows(found, "pid", "category", "event_mo") == [("p1", "lipid_lowering", d("2018-01-01"))]


def test_gp_records(spark, demographics):
    wards = spark.createDataFrame(
        [("E01A", "E08000012", "Liverpool", "W1", "Ward 1"), ("E01B", "E08000012", "Liverpool", "W2", "Ward 2")],
        "LSOA21CD string, LAD24CD string, LAD24NM string, WD24CD string, WD24NM string",
    )
    people = studies.gp_cohort(demographics, wards)
    assert rows(people, "pid") == [("p1",), ("p2",)]
    archive = spark.createDataFrame(
        [("p1", d("2024-05-01"), "c1", None, d("2020-01-31"), "2025-02-04 00:00"),
         ("p1", d("2024-05-01"), "c2", None, d("2021-01-31"), "2025-02-04 00:00"),
         ("p1", d("2024-05-02"), "c1", 30.0, d("2021-01-31"), "2025-02-04 00:00"),
         ("p1", d("2024-05-03"), "c1", 30.0, d("2021-01-31"), "2024-02-04 00:00")],
        "NHS_NUMBER_DEID string, DATE date, CODE string, VALUE1_CONDITION double, "
        "REPORTING_PERIOD_END_DATE date, ProductionDate string",
    )
    clusters = spark.createDataFrame(
        [("NDABMI_COD", "c1", "Body mass index"), ("NDASMOK_COD", "c2", "Child smoker"), ("X", "c3", "Other")],
        "Cluster_ID string, ConceptId string, ConceptId_Description string",
    )
    follow = studies.gp_follow_up(archive, people)
    assert rows(follow, "pid", "start_date", "end_date") == [("p1", d("2018-01-30"), d("2025-03-31"))]
    found = studies.risk_factors(archive, clusters, follow)
    assert rows(found, "rf", "event_date") == [("BMI", d("2024-05-02")), ("Smoking", d("2024-05-01"))]
    assert rows(ev.measure_trend(found), "test_mo", "rf", "total_count") == [
        (d("2024-05-01"), "BMI", 1), (d("2024-05-01"), "Smoking", 1),
    ]
    listed = clusters.select("ConceptId", "ConceptId_Description")
    everyone = studies.gp_cohort(demographics, wards, flagged=False)
    assert rows(studies.gp_events(archive, everyone, listed, listed), "pid", "event_date", "code") == [
        ("p1", d("2024-05-01"), "c1")
    ]


def test_rates_to_trends(spark, cohort):
    history = spark.createDataFrame(
        [(f"{y}-06-01", b, a, 1000.0) for y in range(2018, 2024) for b in ("18-39", "40-59", "60-79", "80")
         for a in ("Barnet", "Brent")],
        "year string, age_gp string, lad string, population double",
    )
    people = studies.population(history)
    assert people.where("year = 2024").count() == 24
    events = spark.range(24).selectExpr(
        "'p1' AS pid", "'Barnet' AS area", "DATE'1950-01-01' AS dob",
        "add_months(DATE'2019-01-05', CAST(id AS INT)) AS event_date",
    ).withColumn("event_mo", F.trunc("event_date", "month"))
    rate = studies.labelled_rates(events, cohort, people)
    assert rate.count() == 24
    first = rate.first()
    assert first["area_label"] == "Barnet(Mean IMD Decile:4.5)"
    assert first["age_standardised_rate"] == pytest.approx(100 * 0.21385191984090562)
    series = pipelines.chart_series(rate, ("area_label",))
    assert series.where("covid_period = 'Pre-COVID'").count() == 14


def test_population_files(spark, tmp_path):
    block = '"Date :",{y}\n"lad","Age"\n"local authority","Age 18","Aged 20-24","All"\n"Barnet","1,000",{n},9\n{end}'
    text = '"Population"\n' + block.format(y=2018, n=20, end='"a"\n"b"\n') + block.format(y=2019, n=30, end="")
    (tmp_path / "export.csv").write_text(text)
    found = studies.population_from_exports(spark, str(tmp_path / "export.csv"))
    assert rows(found, "year", "age_gp", "area", "area_code", "population") == [
        (2018, "18-39", "Barnet", "E09000003", 1020.0), (2019, "18-39", "Barnet", "E09000003", 1030.0),
    ]
    next_year = pipelines.projected_population(found, 2020).where("year_mo = DATE'2020-05-01'")
    assert rows(next_year, "`18-39`", "`80+`") == [(1040.0, None)]
    (tmp_path / "pop_2018.csv").write_text("Age,Halton\nAge 18,5\nAged 20-24,6\n")
    found = studies.population_from_yearly_files(spark, [str(tmp_path / "pop_2018.csv")])
    assert rows(found, "year", "age_gp", "area_code", "population") == [(2018, "18-39", "E06000006", 11.0)]
