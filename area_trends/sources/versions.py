"""Tables that are replaced as a whole: readers see the old rows or the new ones, never a mixture."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MARKS = "_versions"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and a function from text to its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of the published versions, oldest first."""
    files, make = _folder(spark, path)
    marks = make(f"{path}/{MARKS}")
    if not files.exists(marks):
        return []
    names = [s.getPath().getName() for s in files.listStatus(marks)]
    found = [n.split(".", 1) for n in names if n.split(".", 1)[0].isdigit()]
    return sorted((int(number), f"{path}/{folder}") for number, folder in found)


def publish_table(df: DataFrame, path: str, grace: int = 2) -> DataFrame:
    """Replaces a table by these rows, and returns it as published.

    The rows are written to a folder of their own. Only when all are there, a mark with the
    next number that names the folder is made: one new empty file, so readers see the version or do not. A
    writer that ends before leaves the old version in place; its folder goes with the versions of its time. Of two
    writers at the same time one version follows the other; the larger name wins where their numbers are equal.
    Readers that opened an older version go on reading it until `grace` newer ones were published
    after it; then its mark and its folder are removed.
    """
    if grace < 1:
        raise ValueError("a version must outlive the next one, as readers may have opened it")
    spark = df.sparkSession
    files, make = _folder(spark, path)
    held = versions(spark, path)
    number = held[-1][0] + 1 if held else 1
    folder = f"version-{number:09d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    files.mkdirs(make(f"{path}/{MARKS}"))
    files.create(make(f"{path}/{MARKS}/{number:09d}.{folder}"), False).close()
    _remove_before(spark, path, number - grace)
    return spark.read.schema(df.schema).parquet(f"{path}/{folder}")


def _remove_before(spark: SparkSession, path: str, number: int) -> None:
    """Removes the versions below a number: marks first, so that no reader finds a folder that goes."""
    files, make = _folder(spark, path)
    for old, folder in versions(spark, path):
        if old < number:
            files.delete(make(f"{path}/{MARKS}/{old:09d}.{folder.rpartition('/')[2]}"), False)
    for status in files.listStatus(make(path)):
        name = status.getPath().getName()
        if name.startswith("version-") and int(name.split("-")[1]) < number:
            files.delete(status.getPath(), True)


def published_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table; which one it is, is settled here, not when it is read."""
    held = versions(spark, path)
    if not held:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(held[-1][1])
