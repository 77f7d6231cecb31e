"""Published tables, snapshots as of a day, and differences between snapshots."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from helpers import d, plan_of, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from area_trends.sources import snapshots as sn
from area_trends.sources import versions as vs

ROOT = Path(__file__).resolve().parents[1]


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        vs.published_table(spark, path)
    vs.publish_table(spark.range(3), path)
    opened = vs.published_table(spark, path)
    vs.publish_table(spark.range(5), path)
    assert opened.count() == 3 and vs.published_table(spark, path).count() == 5
    vs.publish_table(spark.range(7), path)
    assert opened.count() == 3  # within the grace of two
    vs.publish_table(spark.range(0), path)
    assert [n for n, _ in vs.versions(spark, path)] == [2, 3, 4]
    assert vs.published_table(spark, path).count() == 0
    assert sorted(p.name[:17] for p in (tmp_path / "t").glob("version-*")) == [f"version-{n:09d}" for n in (2, 3, 4)]
    with pytest.raises(ValueError):
        vs.publish_table(spark.range(1), path, grace=0)


def test_a_table_can_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    vs.publish_table(spark.range(4), path)
    held = vs.published_table(spark, path)
    vs.publish_table(held.selectExpr("id * 2 AS id"), path)
    assert rows(vs.published_table(spark, path), "id") == [(0,), (2,), (4,), (6,)]


WRITER = """
    import os, sys
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from area_trends.sources import versions as vs

    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()

    def dies(batches):
        for batch in batches:
            yield batch
            if batch["id"].max() >= 400:
                os.kill({pid}, 9)
                import time
                time.sleep(60)

    rows = spark.range(0, 1000, 1, 10).mapInPandas(dies, "id long")
    vs.publish_table(rows, {path!r})
"""


def test_a_killed_writer_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    vs.publish_table(spark.range(3), path)
    code = textwrap.dedent(WRITER).format(root=str(ROOT), path=path, pid="PID")
    code = code.replace("os.kill(PID, 9)", "os.kill(int(os.environ['WRITER']), 9)")
    runner = "import os; os.environ['WRITER'] = str(os.getpid())\n" + code
    done = subprocess.run([sys.executable, "-c", runner], env=os.environ, capture_output=True, timeout=180)
    assert done.returncode == -9
    left = [p.name for p in Path(path).glob("version-000000002-*")]
    assert left, "the writer was killed before it had begun"
    assert vs.published_table(spark, path).count() == 3
    for n in (5, 6, 7, 8):
        vs.publish_table(spark.range(n), path)
    assert vs.published_table(spark, path).count() == 8
    assert not (Path(path) / left[0]).exists()  # gone with the versions of its time


def archive(spark, path):
    rows_ = [(i, f"x{i}", day) for day, n in (("2020-01-31", 3), ("2020-02-29", 4), ("2021-01-01", 5)) for i in range(n)]
    rows_.append((9, "y", "draft"))
    spark.createDataFrame(rows_, "id int, x string, archived_on string").write.partitionBy("archived_on").parquet(path)
    return path


def test_as_of(spark, tmp_path):
    path = archive(spark, str(tmp_path / "a"))
    assert sn.snapshot_dates(spark, path) == ["2020-01-31", "2020-02-29", "2021-01-01"]
    for day, n in (("2020-01-31", 3), ("2020-02-28", 3), ("2020-02-29", 4), ("2020-12-31", 4), ("2030-01-01", 5)):
        assert sn.snapshot_as_of(spark, path, day).count() == n
    for wrong in ("2020-01-30", "never", "2020-1-31"):
        with pytest.raises(ValueError):
            sn.snapshot_as_of(spark, path, wrong)


def test_as_of_reads_one_folder(spark, tmp_path):
    path = archive(spark, str(tmp_path / "a"))
    found = sn.snapshot_as_of(spark, path, "2020-12-31")
    assert "PartitionFilters: [isnotnull(archived_on" in plan_of(found)
    found.collect()
    node = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert node.metrics().apply("numPartitions").value() == 1


VALUES = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["a", "b", None]), st.sampled_from(["a", None])), max_size=8)


@settings(max_examples=25, deadline=None)
@given(VALUES, VALUES)
def test_difference(spark, old, new):
    a, b = (spark.createDataFrame(x, "k int, x string, y string") for x in (old, new))
    found = {r["k"]: r["change"] for r in sn.snapshot_difference(a, b, ("k",)).collect()}
    expected = {}
    for k in {r[0] for r in old + new}:
        left, right = (sorted((r for r in x if r[0] == k), key=str) for x in (old, new))
        if left != right:
            expected[k] = "changed" if left and right else "removed" if left else "added"
    assert found == expected


def test_difference_takes_one_shuffle(spark):
    a = spark.createDataFrame([(1, d("2020-01-01"))], "k int, day date")
    plan = plan_of(sn.snapshot_difference(a, a, ("k",)))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
