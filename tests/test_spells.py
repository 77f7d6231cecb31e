"""Spells: union, events inside, person-months, against going through the days."""

import datetime as dt

import pytest
from helpers import d, plan_of, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from area_trends.operators import events as ev
from area_trends.operators import spells as sp

DAY = dt.timedelta(days=1)
BASE = d("2020-01-30")
SCHEMA = "pid int, start_date date, end_date date"


def days_of(held, end=None):
    """Days followed per person."""
    found = {}
    for pid, a, b in held:
        b = min(x for x in (b, end) if x) if (b or end) else None
        if a and b:
            found.setdefault(pid, set()).update(a + i * DAY for i in range((b - a).days + 1))
    return {p: s for p, s in found.items() if s}


def islands(days):
    out = []
    for pid, held in days.items():
        for day in sorted(held):
            if out and out[-1][0] == pid and out[-1][2] + DAY == day:
                out[-1][2] = day
            else:
                out.append([pid, day, day])
    return sorted(map(tuple, out))


CASES = [
    (1, d("2020-01-01"), d("2020-01-10")),
    (1, d("2020-01-11"), d("2020-01-12")),  # touches
    (1, d("2020-01-03"), d("2020-01-05")),  # nested
    (1, d("2020-01-01"), d("2020-01-10")),  # repeated
    (1, d("2020-01-14"), d("2020-01-14")),
    (2, d("2020-01-01"), None),
    (2, None, d("2020-01-02")),
    (3, d("2020-01-02"), d("2020-01-01")),
    (4, d("2020-01-01"), d("2020-06-01")),
    (None, d("2020-01-01"), d("2020-01-02")),
    (None, d("2020-01-02"), d("2020-01-03")),
]


def test_union(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    known = [c for c in CASES if c[0] is not None]
    assert [r for r in rows(sp.union_spells(df), *df.columns) if r[0]] == islands(days_of(known))
    cut = d("2020-02-01")
    found = [r for r in rows(sp.union_spells(df, study_end="2020-02-01"), *df.columns) if r[0]]
    assert found == islands(days_of(known, cut))
    assert (None, d("2020-01-01"), d("2020-01-03")) in rows(sp.union_spells(df), *df.columns)
    near = rows(sp.union_spells(df.where("pid = 1"), gap_days=1), *df.columns)
    assert near == [(1, d("2020-01-01"), d("2020-01-14"))]
    assert sp.union_spells(df.limit(0)).count() == 0


SPELLS = st.lists(
    st.tuples(st.integers(1, 2), st.integers(0, 120), st.integers(-2, 70)).map(
        lambda x: (x[0], BASE + x[1] * DAY, BASE + (x[1] + x[2]) * DAY)
    ),
    max_size=12,
)


@settings(max_examples=15, deadline=None)
@given(SPELLS, SPELLS)
def test_union_can_be_continued(spark, first, second):
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (first, second))
    merged = sp.union_spells(sp.union_spells(a).unionByName(b))
    assert rows(merged, "pid", "start_date", "end_date") == islands(days_of(first + second))


@settings(max_examples=15, deadline=None)
@given(SPELLS, st.lists(st.tuples(st.integers(1, 3), st.integers(-5, 200)), max_size=15), st.sampled_from([1, 7, 365]))
def test_events(spark, held, events, bins):
    spells = spark.createDataFrame(held, SCHEMA)
    events = [(pid, BASE + n * DAY, i % 2) for i, (pid, n) in enumerate(events)]
    df = spark.createDataFrame(events, "pid int, event_date date, x int")
    found = sp.events_in_spells(df, spells, bin_days=bins)
    days = days_of(held)
    expected = [
        (*e, a, b) for e in events for pid, a, b in islands(days) if e[0] == pid and a <= e[1] <= b
    ]
    names = ("pid", "event_date", "x", "start_date", "end_date")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select(*names).collect()), key=key) == sorted(expected, key=key)
    pairs = sp.spell_join(df, spells, bin_days=bins).select(*names)
    every = [(*e, a, b) for e in events for pid, a, b in held if e[0] == pid and a <= e[1] <= b]
    assert sorted(map(tuple, pairs.collect()), key=key) == sorted(every, key=key)


@settings(max_examples=15, deadline=None)
@given(SPELLS)
def test_person_months(spark, held):
    persons = spark.createDataFrame(
        [(1, d("1980-03-31"), "M"), (2, d("1980-02-10"), "F")], "pid int, dob date, sex string"
    )
    found = sp.spell_person_months(spark.createDataFrame(held, SCHEMA), persons, ("sex",))
    counts = {}
    for pid, a, b in islands(days_of(held)):
        month = a.year * 12 + a.month - 1
        for k in range((b.year - a.year) * 12 + b.month - a.month + 1):
            y, m = divmod(month + k, 12)
            last = (dt.date(y + m // 11, (m + 1) % 12 + 1, 1) - DAY).day
            day = dt.date(y, m + 1, min(a.day, last))
            if day <= b and (pid, y, m + 1) not in counts:
                dob = (d("1980-03-31"), d("1980-02-10"))[pid - 1]
                counts[pid, y, m + 1] = "18-39" if (day - dob).days / 365.25 < 40 else "40-59"
    expected = {}
    for (pid, y, m), band in counts.items():
        key = (y, m, band, "MF"[pid - 1])
        expected[key] = expected.get(key, 0) + 1
    assert {tuple(r)[:4]: r["count"] for r in found.select("year", "month", "age_gp", "sex", "count").collect()} == expected


def test_a_frequent_person_is_spread_over_bins(spark):
    """One person with very many spells and events: the sweep sees a row per day at most."""
    n = 60_000
    spells = spark.range(n).select(
        F.lit(1).alias("pid"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 3000).cast("int")).alias("start_date"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 3000 + F.col("id") % 5).cast("int")).alias("end_date"),
    )
    assert rows(sp.union_spells(spells), "start_date", "end_date") == [(d("2000-01-01"), d("2008-03-22"))]
    events = spark.range(n).select(
        F.lit(1).alias("pid"),
        F.date_add(F.lit("1999-06-01").cast("date"), (F.col("id") % 4000).cast("int")).alias("event_date"),
    )
    found = sp.events_in_spells(events, spells)
    inside = [x for x in range(4000) if 0 <= (d("1999-06-01") - d("2000-01-01")).days + x <= 3003]
    assert found.count() == sum(n // 4000 for _ in inside)
    assert "partial_max(end_date" in plan_of(sp.union_spells(spells))


def test_join_is_an_equality(spark):
    spells = spark.createDataFrame(CASES, SCHEMA)
    events = spark.createDataFrame([(1, d("2020-01-02"))], "pid int, event_date date")
    plan = plan_of(sp.events_in_spells(events, spells))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_bin" in plan


def test_measures_inside_any_spell(spark):
    """A record that several spells hold is one row, with the smallest attributes; one between spells is none."""
    follow = spark.createDataFrame(
        [
            (1, d("2020-01-01"), d("2020-03-01"), "E2", "M", "x", "18-39"),
            (1, d("2020-02-01"), d("2020-02-10"), "E1", "M", "x", "18-39"),
            (1, d("2021-01-01"), d("2021-03-01"), "E3", "M", "x", "40-59"),
        ],
        "pid int, start_date date, end_date date, lsoa string, sex string, ethnicity string, age_gp string",
    )
    days = ["2020-01-05", "2020-02-05", "2020-02-05", "2020-06-01", "2021-03-01", "2021-03-02"]
    records = spark.createDataFrame([(1, d(x), "BMI", 1.0) for x in days], "pid int, event_date date, rf string, value double")
    for option in (True, False):
        found = ev.followed_measures(records, follow, spells=option)
        assert rows(found, "event_date", "lsoa", "age_gp") == [
            (d("2020-01-05"), "E2", "18-39"),
            (d("2020-02-05"), "E1", "18-39"),
            (d("2021-03-01"), "E3", "40-59"),
        ]


@pytest.mark.parametrize("name", ["spell_union", "events_in_spells", "spell_person_months"])
def test_queries_are_registered(name):
    from area_trends.plans.oracle import ORACLE
    from area_trends.plans.queries import QUERIES

    assert name in QUERIES and name in ORACLE
