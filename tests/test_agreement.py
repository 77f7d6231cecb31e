"""Agreement of sources by person, against going through the pairs."""

from itertools import combinations

from helpers import d, plan_of, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from area_trends.operators import compare

NAMES = ("a", "b", "c")


def brute(sources):
    held = {}
    for name, events in zip(NAMES, sources, strict=True):
        for pid, day in events:
            if pid is not None and day is not None:
                held.setdefault((pid, day.replace(day=1)), {}).setdefault(name, set()).add(day)
    for (pid, month), found in held.items():
        bits = sum(1 << i for i, n in enumerate(NAMES) if n in found)
        near = [
            min((abs((x - y).days) for x in found.get(p, ()) for y in found.get(q, ())), default=None)
            for p, q in combinations(NAMES, 2)
        ]
        yield pid, month, bits, *[n in found for n in NAMES], *near


EVENTS = st.lists(
    st.tuples(st.sampled_from([1, 2, None]), st.dates(d("2020-01-01"), d("2020-03-31")) | st.none()), max_size=10
)


@settings(max_examples=25, deadline=None)
@given(EVENTS, EVENTS, EVENTS)
def test_agreement(spark, a, b, c):
    sources = (a, b, c)
    frames = {n: spark.createDataFrame(s, "pid int, event_date date") for n, s in zip(NAMES, sources, strict=True)}
    found = compare.person_agreement(frames)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(sources), key=key)


def test_all_days_of_a_month(spark):
    days = [d(f"2020-01-{n:02d}") for n in (1, 31)]
    for x in days:
        for y in days:
            frames = {n: spark.createDataFrame([(1, v)], "pid int, event_date date") for n, v in (("a", x), ("b", y))}
            assert compare.person_agreement(frames).first()["days_a_b"] == abs((x - y).days)


def test_one_shuffle_for_any_number_of_sources(spark):
    frames = {f"s{i}": spark.createDataFrame([(i, d("2020-01-05"))], "pid int, event_date date") for i in range(5)}
    found = compare.person_agreement(frames)
    plan = plan_of(found)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert rows(found, "pid", "sources") == [(i, 1 << i) for i in range(5)]


def test_by_month(spark):
    frames = {
        "a": spark.createDataFrame([(1, d("2020-01-05")), (2, d("2020-01-01")), (3, d("2020-01-01"))], "pid int, event_date date"),
        "b": spark.createDataFrame([(1, d("2020-01-05")), (2, d("2020-01-20")), (4, d("2020-02-01"))], "pid int, event_date date"),
    }
    found = compare.agreement_by_month(compare.person_agreement(frames), "a", "b")
    assert rows(found, "event_mo", "n_both", "n_only_a", "n_only_b", "n_same_day", "n_near") == [
        (d("2020-01-01"), 2, 1, 0, 1, 1),
        (d("2020-02-01"), 0, 0, 1, 0, 0),
    ]
