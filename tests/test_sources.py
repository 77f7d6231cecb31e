import csv
from pathlib import Path

import pytest
from helpers import d, plan_of, rows
from pyspark.sql import functions as F

from area_trends.sources import files, tables


def test_csv_blanks_are_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,term,n\n1,,5\n,x,\n")
    (tmp_path / "b.csv").write_text('code,term,n\n2,"p, q",6\n')
    found = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "code string, term string, n int")
    assert rows(found, "code", "term", "n") == [("", "x", None), ("1", "", 5), ("2", "p, q", 6)]


def test_csv_types_can_be_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n\nx,5\n,6\n")
    found = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert found.dtypes == [("code", "string"), ("n", "int")]
    assert rows(found, "code", "n") == [("", 6), ("x", 5)]


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "a.csv").write_text("term,code\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "a.csv"), "code string, term string").collect()


def test_tsv_is_trimmed(spark, tmp_path):
    (tmp_path / "codes.tsv").write_text("icd\tdescription\ttype\nI63\tCerebral infarction\tischaemic \n")
    found = files.read_tsv(spark, str(tmp_path / "codes.tsv"), "icd string, description string, type string")
    assert rows(found, "icd", "type") == [("I63", "ischaemic")]


def test_population_long(spark, tmp_path):
    (tmp_path / "pop_2018.csv").write_text('Age,X,Y\nAge 18,"1,234",!\nAll ages,5,6\n')
    (tmp_path / "pop_2019.csv").write_text("Age,Y,Z\nAged 85+,7,8\n")
    paths = [str(tmp_path / f"pop_{y}.csv") for y in (2018, 2019)]
    found = files.population_long(spark, paths)
    assert rows(found, "year", "mid_year", "age_gp", "area", "population") == [
        (2018, d("2018-06-01"), "18-39", "X", 1234.0),
        (2018, d("2018-06-01"), "18-39", "Y", None),
        (2018, d("2018-06-01"), None, "X", 5.0),
        (2018, d("2018-06-01"), None, "Y", 6.0),
        (2019, d("2019-06-01"), "80+", "Y", 7.0),
        (2019, d("2019-06-01"), "80+", "Z", 8.0),
    ]


BLOCKS = '''"Population"

"Date :",2018,,
,,
"lad","Age"
"local authority","Age 18","Aged 20-24"
"Barnet","1,000",20
"Brent",3,!

"Population estimates"
"Source, as given"
"Date :",2019,,
"lad","Age"
"local authority","Age 18","Aged 20-24"
"Barnet",5,6
'''


def test_population_blocks(spark, tmp_path):
    for name, text in (("one.csv", BLOCKS), ("two.csv", BLOCKS.replace("\n", "\r\n").replace("Barnet", "Bexley"))):
        (tmp_path / name).write_bytes(text.encode())
    found = files.population_blocks(spark, str(tmp_path / "one.csv"))
    expected = [
        (2018, "Barnet", "Age 18", 1000.0), (2018, "Barnet", "Aged 20-24", 20.0),
        (2018, "Brent", "Age 18", 3.0), (2018, "Brent", "Aged 20-24", None),
        (2019, "Barnet", "Age 18", 5.0), (2019, "Barnet", "Aged 20-24", 6.0),
    ]
    assert rows(found, "year", "area", "age", "population") == expected
    both = files.population_blocks(spark, str(tmp_path))
    assert both.count() == 12
    wide = files.ages_by_area(found, ["Barnet", "Brent"])
    assert rows(wide.where("year = 2018"), "Age", "Barnet", "Brent") == [
        ("Age 18", 1000.0, 3.0), ("Aged 20-24", 20.0, None),
    ]


def test_snapshot_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "archive")
    spark.range(6).selectExpr("id", "IF(id < 2, '2024-12-02', '2025-04-24') AS archived_on").write.partitionBy(
        "archived_on"
    ).parquet(path)
    archive = spark.read.schema("id long, archived_on string").parquet(path)
    found = tables.snapshot(archive, "2024-12-02")
    assert rows(found, "id") == [(0,), (1,)]
    assert "PartitionFilters: [isnotnull(archived_on" in plan_of(found)
    assert tables.snapshot(archive, "2025", prefix=True).count() == 4


def test_tables_and_sinks(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "CAST(id AS STRING) AS text")
    for _ in range(2):
        saved = tables.save_table(df, "area_trends_test", str(tmp_path / "t"))
    assert saved.count() == 5
    spark.sql("DROP TABLE area_trends_test")
    tables.save_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "id long, text string").count() == 5


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(100).selectExpr("id % 10 AS pid", "id AS event_id")
        b = spark.range(10).selectExpr("id AS pid", "id AS area")
        for name, df in (("area_trends_a", a), ("area_trends_b", b)):
            tables.save_table(df, name, str(tmp_path / name), bucket_by="pid", buckets=4)
        joined = spark.table("area_trends_a").join(spark.table("area_trends_b"), "pid")
        assert joined.count() == 100
        assert "Exchange" not in plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("area_trends_a", "area_trends_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_materialise_uses_the_checkpoint_folder(spark):
    df = spark.range(5).selectExpr("id", "id % 2 = 0 AS even")
    stored = tables.materialise(df, "even")
    assert stored.dtypes == df.dtypes and stored.count() == 5
    base = spark.conf.get("spark.checkpoint.dir")
    assert base in stored.inputFiles()[0]


class _Session:
    """Stands in for a session without the setting."""

    def __init__(self, master):
        self.conf = {"spark.master": master}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    assert "area_trends_" in tables.shared_folder(_Session("local[2]"))
    with pytest.raises(ValueError):
        tables.shared_folder(_Session("yarn"))


def test_clear_scratch_removes_what_was_written(spark):
    stored = tables.materialise(spark.range(3), "gone")
    path = Path(stored.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    assert path.exists()
    tables.clear_scratch(spark)
    assert not path.exists()
    assert tables.materialise(spark.range(3), "again").count() == 3


def test_drop_scratch_removes_some(spark):
    before = tables.scratch_paths()
    gone, kept = tables.materialise(spark.range(3), "gone"), tables.materialise(spark.range(4), "kept")
    first, second = [p for p in tables.scratch_paths() if p not in before]
    tables.drop_scratch(spark, [first])
    assert tables.scratch_paths() == [*before, second] and kept.count() == 4
    assert "gone" in first and not spark.read.parquet(second).isEmpty()
    with pytest.raises(Exception, match="(?i)not exist|no such file|not found"):
        gone.collect()


QUOTED = [(1, 'Stroke "NOS", left'), (2, "two\nlines"), (3, "plain"), (4, ""), (5, '"')]


def test_csv_as_other_programs_write_and_read_it(spark, tmp_path):
    with (tmp_path / "terms.csv").open("w", newline="") as file:
        csv.writer(file).writerows([("code", "term"), *QUOTED])
    found = files.read_csv(spark, str(tmp_path / "terms.csv"), "code int, term string", multi_line=True)
    assert rows(found, "code", "term") == sorted(QUOTED)
    tables.save_csv(found.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    with part.open(newline="") as file:
        assert sorted(csv.reader(file)) == sorted([["code", "term"], *[[str(c), t] for c, t in QUOTED]])


def test_tsv_with_quotes(spark, tmp_path):
    (tmp_path / "codes.tsv").write_text('code\tterm\nA1\t"a ""b"", c" \nA2\tplain \n')
    found = files.read_tsv(spark, str(tmp_path / "codes.tsv"), "code string, term string")
    assert rows(found, "code", "term") == [("A1", 'a "b", c'), ("A2", "plain")]


def test_only_numbers_are_numbers(spark):
    texts = ["1,234", " -5.5 ", "1e3", ".5", "7.", "NaN", "Infinity", "12d", "-", "1.2.3", "", None, "0x1", "1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r["n"] for r in df.select(files.number_from_text(F.col("t")).alias("n")).collect()]
    assert found == [1234.0, -5.5, 1000.0, 0.5, 7.0] + [None] * 9


def test_many_population_files_need_no_job_each(spark, tmp_path):
    paths = []
    for year in range(1970, 2020):
        path = tmp_path / f"pop_{year}.csv"
        path.write_text(f'Age,A,"B, ""b"""\nAged 40-44,"{year:,}",NaN\n')
        paths.append(str(path))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    long = files.population_long(spark, paths)
    # Spark lists more than 32 paths by one job of its own
    assert len(tracker.getJobIdsForGroup(None)) <= before + 1
    assert plan_of(long).count("FileScan") == 1
    assert long.count() == 100
    assert rows(long.where("area = 'A' AND year > 2017"), "year", "population") == [(2018, 2018.0), (2019, 2019.0)]
    assert rows(long.where("year = 1970 AND area <> 'A'"), "area", "population") == [('B, "b"', None)]
