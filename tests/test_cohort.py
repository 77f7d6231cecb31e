import datetime as dt
import math
import random
from collections import Counter

from helpers import d, rows
from pyspark.sql import functions as F

from area_trends.operators.cohort import area_lookup, build_cohort, follow_up, person_months

PERSON = "pid long, dob date, sex string, ethnicity string, lsoa string, imd10 int, imd5 int"


def _born(age, index="2018-04-01"):
    return d(index) - dt.timedelta(days=math.ceil(age * 365.25))


def _areas(spark):
    return spark.createDataFrame([("E01A", "X"), ("W01A", "Y")], "lsoa string, area string")


def test_area_lookup_restricts_and_dedupes(spark):
    df = spark.createDataFrame(
        [("a", "X", "E1"), ("a", "X", "E1"), ("b", "Y", "E2"), ("c", "Z", "E3")],
        "lsoa string, area string, area_code string",
    )
    assert rows(area_lookup(df, ["E1", "E2"]), "lsoa", "area") == [("a", "X"), ("b", "Y")]


def test_cohort_limits(spark):
    index = "2018-04-01"
    people = [
        (1, _born(17.99), "M", "White", "E01A", 4, 2),
        (2, _born(18), "M", None, "E01A", 4, 2),
        (3, _born(112), "F", "Other ethnic group", "E01A", 4, 2),
        (4, _born(112.1), "F", "White", "E01A", 4, 2),
        (5, _born(50), None, "White", "E01A", 4, 2),
        (6, _born(50), "F", "White", "W01A", 4, 2),
        (7, _born(50), "F", "White", "E01A", None, 2),
        (8, _born(50), "F", "White", "E01B", 4, 2),
        (9, _born(50), "I", "White", "E01A", 4, 2),
    ]
    person = spark.createDataFrame(people, PERSON)
    found = build_cohort(person, _areas(spark), index)
    assert rows(found, "pid", "ethnicity", "area", "age_gp") == [
        (2, "Other/Unknown", "X", "18-39"),
        (3, "Other/Unknown", "X", "80+"),
    ]
    unlimited = build_cohort(person, _areas(spark), index, max_age=None, deprivation_col="imd5")
    assert {r["pid"] for r in unlimited.collect()} == {2, 3, 4, 7}


def test_cohort_flag(spark):
    person = spark.createDataFrame(
        [(1, _born(30), "M", "White", "E01A", 1, 1, 1), (2, _born(30), "M", "White", "E01A", 1, 1, 0)],
        PERSON + ", in_gp int",
    )
    found = build_cohort(person, _areas(spark), "2018-04-01", flag_col="in_gp", band_rule="open")
    assert rows(found, "pid", "age_gp") == [(1, "18-39")]


def test_follow_up_needs_a_month(spark):
    people = spark.createDataFrame(
        [(1, d("2024-02-29")), (2, d("2024-02-28")), (3, None), (4, None)], "pid long, dod date"
    )
    start = d("2024-01-31") + dt.timedelta(days=731)
    records = spark.createDataFrame(
        [(1, start), (1, start + dt.timedelta(days=9)), (2, start), (3, start)],
        "pid long, record_date date",
    )
    found = follow_up(people, records, "2025-03-31")
    assert rows(found, "pid", "start_date", "end_date") == [
        (1, d("2024-01-31"), d("2024-02-29")),
        (3, d("2024-01-31"), d("2025-03-31")),
    ]


def _add_months(day, k):
    n = day.year * 12 + day.month - 1 + k
    first = dt.date(n // 12, n % 12 + 1, 1)
    following = dt.date((n + 1) // 12, (n + 1) % 12 + 1, 1)
    return first + dt.timedelta(days=min(day.day, (following - first).days) - 1)


def _band(day, dob):
    if dob is None:
        return "80+"
    age = (day - dob).days / 365.25
    return next(b for b, u in (("18-39", 40), ("40-59", 60), ("60-79", 80), ("80+", 999)) if age < u)


FOLLOW = "pid long, dob date, start_date date, end_date date, sex string, ethnicity string, lsoa string"


def test_person_months_are_anchored_on_the_start(spark):
    follow = spark.createDataFrame(
        [(1, d("1990-01-01"), d("2024-01-31"), d("2024-05-30"), "M", None, "E01A")], FOLLOW
    )
    assert rows(person_months(follow), "year", "month", "count") == [
        (2024, 1, 1), (2024, 2, 1), (2024, 3, 1), (2024, 4, 1),
    ]


def test_person_months_equal_counting_every_month(spark):
    rng = random.Random(7)
    data, expected = [], Counter()
    for pid in range(400):
        start = dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(1500))
        end = start + dt.timedelta(days=rng.randrange(0, 2500))
        # Births such that band limits fall inside the follow-up, on odd days too.
        age = rng.choice([39, 59, 79, 25, 85])
        dob = start - dt.timedelta(days=int(age * 365.25) + rng.randrange(400))
        dob = None if pid % 50 == 0 else dob
        sex, eth, lsoa = rng.choice("MF"), rng.choice(["A", None]), rng.choice(["E011", "E012"])
        data.append((pid, dob, start, end, sex, eth, lsoa))
        k = 0
        while _add_months(start, k) <= end:
            day = _add_months(start, k)
            expected[(day.year, day.month, _band(day, dob), sex, eth, lsoa)] += 1
            k += 1
    found = person_months(spark.createDataFrame(data, FOLLOW))
    columns = ("year", "month", "age_gp", "sex", "ethnicity", "lsoa", "count")
    got = {tuple(r)[:-1]: r["count"] for r in found.select(*columns).collect()}
    assert got == dict(expected)
    assert found.agg(F.sum("count")).first()[0] == sum(expected.values())
