"""Files read as splits: order across splits, and lines that do not fit."""

import csv
from contextlib import contextmanager

import pytest
from helpers import plan_of, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from area_trends.sources import files, lines
from area_trends.sources.tables import materialise


@contextmanager
def split_bytes(spark, size):
    """Files are cut into splits of about this size, however small they are."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def blocks(path, trailing=2):
    """The rows of an export, line by line."""
    year, n, names, held, found = None, 0, None, [], []
    for i, line in enumerate(path.read_text().split("\n")):
        f = [x.strip() or None for x in next(csv.reader([line]), [])]
        if i == 0 or not any(f):
            continue
        if f[0] and "Date" in f[0]:
            found += held[: len(held) - trailing] if held and year is not None else []
            year, n, names, held = f[1], 0, None, []
            continue
        if year is None:
            continue
        n += 1
        held.append((n, year, names, f))
        if n == 2:
            names = f
    found += held
    for n, year, names, f in found:
        if n > 2:
            for age, value in zip(names[1:], f[1:], strict=False):
                yield int(year), f[0], age, None if value is None else float(value.replace(",", ""))


def export(path, years, areas, ages):
    with path.open("w", newline="") as file:
        out = csv.writer(file, lineterminator="\n")
        out.writerow(["A title with Date"])
        out.writerow([])
        for y in years:
            out.writerow(["Date :", y])
            out.writerow([""] * 3)
            out.writerow(["lad", "Age"])
            out.writerow(["local authority", *[f"Age {a}" for a in range(ages)]])
            for a in range(areas):
                out.writerow([f"Area {a}, {y}", *[f"{y * 1000 + a * 10 + k:,}" for k in range(ages)]])
            if y != years[-1]:
                out.writerows([[], ["Estimates"], ["Source"]])


@pytest.mark.parametrize("size", [40, 300, 100_000])
def test_blocks_over_many_splits(spark, tmp_path, size):
    export(tmp_path / "a.csv", list(range(2001, 2007)), 7, 3)
    export(tmp_path / "b.csv", [2010], 2, 2)
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("Title\n\nno block, 1\n")
    with split_bytes(spark, size):
        n = lines.file_lines(spark, str(tmp_path)).select("file", "start").distinct().count()
        found = files.population_blocks(spark, str(tmp_path))
        expected = [r for f in ("a", "b") for r in blocks(tmp_path / f"{f}.csv")]
        assert rows(found, "year", "area", "age", "population") == sorted(
            expected, key=lambda r: tuple((v is None, str(v)) for v in r)
        )
    assert len(expected) == 6 * 7 * 3 + 2 * 2
    assert n >= 8 or size == 100_000


def test_blocks_are_not_brought_together_by_file(spark, tmp_path):
    export(tmp_path / "a.csv", [2001, 2002], 3, 2)
    plan = plan_of(files._block_lines(spark, str(tmp_path)))
    assert "wholetext" not in plan.lower()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(file" in line]
    assert windows and all(", start" in line for line in windows if "place" in line or "marks" in line)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["x", "", "long line " * 9, "é"]), max_size=40), st.integers(5, 200))
def test_line_numbers(spark, tmp_path_factory, texts, size):
    path = tmp_path_factory.mktemp("lines")
    (path / "a.txt").write_text("".join(t + "\n" for t in texts))
    (path / "b.txt").write_text("one\ntwo")
    with split_bytes(spark, size):
        stored = materialise(lines.file_lines(spark, str(path)), "lines")
        found = lines.number_lines(stored).collect()
    for name, expected in (("a.txt", texts), ("b.txt", ["one", "two"])):
        here = sorted((r["line_no"], r["line"]) for r in found if r["file"].endswith(name))
        assert here == list(enumerate(expected, 1))


SCHEMA = "id int, name string, day date, x double"


@pytest.mark.parametrize("size", [30, 100_000])
def test_rows_that_do_not_fit(spark, tmp_path, size):
    (tmp_path / "a.csv").write_text(
        'id,name,day,x\n1,"a, ""b""",2020-01-31,1.5\n2,,,\n\n3,c\n4,d,2020-01-01,2,5\n'
        "x,e,2020-02-30,1\n5,f,2020-01-01,y\n   \n6,\"open,2020-01-01,1\n7,g,2020-01-01,-1e3\n"
    )
    (tmp_path / "b.csv").write_text("id,nam,day,x\n8,h,2020-01-01,0\n")
    with split_bytes(spark, size):
        found = lines.read_checked(spark, str(tmp_path), SCHEMA)
        good = {tuple(r) for r in found.good.selectExpr("id", "name", "string(day)", "x").collect()}
        rejected = {(r["file"][-5:], r["line_no"], r["reason"]) for r in found.rejected.collect()}
        totals = {r["file"][-5:]: tuple(r)[1:] for r in found.totals.collect()}
    assert good == {
        (1, 'a, "b"', "2020-01-31", 1.5),
        (2, "", None, None),
        (7, "g", "2020-01-01", -1000.0),
        (8, "h", "2020-01-01", 0.0),
    }
    assert rejected == {
        ("a.csv", 5, "missing fields"),
        ("a.csv", 6, "extra fields"),
        ("a.csv", 7, "wrong type: id, day"),
        ("a.csv", 8, "wrong type: x"),
        ("a.csv", 10, "open quote"),
        ("b.csv", 1, "header"),
    }
    assert totals == {"a.csv": (11, 1, 2, 3, 5), "b.csv": (2, 0, 0, 1, 1)}
    assert all(t[0] == sum(t[1:]) for t in totals.values())


def test_tab_separated_without_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\ta,b\n2\n3\tc\td\n")
    found = lines.read_checked(spark, str(tmp_path / "a.tsv"), "id int, name string", sep="\t", header=False)
    assert rows(found.good, "id", "name") == [(1, "a,b")]
    assert rows(found.rejected, "line_no", "reason") == [(2, "missing fields"), (3, "extra fields")]


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    found = lines.read_checked(spark, str(tmp_path), SCHEMA)
    assert found.good.count() == found.rejected.count() == found.totals.count() == 0


@pytest.mark.parametrize("size", [25, 100_000])
def test_population_lines_that_do_not_fit(spark, tmp_path, size):
    (tmp_path / "pop_2001.csv").write_text(
        'Age,A,"B, c"\nAged 40-44,"1,000",2\n\nAged 45-49,x,NaN\nAged 50-54,1\nAged 55-59,1,2,3\nAged 60-64,,5\n'
    )
    (tmp_path / "pop_2002.csv").write_text("A,B\n1,2\n")
    (tmp_path / "pop_2003.csv").write_text('A,Age\n7,Aged 40-44\n')
    with split_bytes(spark, size):
        found = files.population_checked(spark, [str(p) for p in sorted(tmp_path.glob("*.csv"))])
        good = rows(found.good, "year", "age_gp", "area", "population")
        rejected = {(r["file"][-8:], r["line_no"], r["reason"]) for r in found.rejected.collect()}
        totals = {r["file"][-8:]: tuple(r)[1:] for r in found.totals.collect()}
    assert good == sorted(
        [
            (2001, "40-59", "A", 1000.0),
            (2001, "40-59", "B, c", 2.0),
            (2001, "60-79", "A", None),
            (2001, "60-79", "B, c", 5.0),
            (2003, "40-59", "A", 7.0),
        ],
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )
    assert rejected == {
        ("2001.csv", 4, "no number: A, B, c"),
        ("2001.csv", 5, "missing fields"),
        ("2001.csv", 6, "extra fields"),
        ("2002.csv", 1, "header"),
        ("2002.csv", 2, "header"),
    }
    assert totals == {"2001.csv": (7, 1, 1, 2, 3), "2002.csv": (2, 0, 0, 0, 2), "2003.csv": (2, 1, 0, 1, 0)}
