"""Tables: snapshots, sinks and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import cache
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: set[str] = set()
_PATHS: list[str] = []


def snapshot(df: DataFrame, value: str, column: str = "archived_on", prefix: bool = False) -> DataFrame:
    """Rows of one snapshot; on a partition column only that folder is read."""
    held = F.col(column)
    return df.where(held.startswith(value) if prefix else held == value)


def save_table(
    df: DataFrame,
    name: str,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    bucket_by: str | None = None,
    buckets: int = 0,
) -> DataFrame:
    """Writes a Parquet table, replacing an older one, and returns it re-read.

    `partition_by` makes one folder per value (for snapshots); `bucket_by` with
    `buckets` lays rows out by a key, so that later joins and groups on it, between
    tables with equally many buckets, need no shuffle.
    """
    writer = df.write.format("parquet").mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by is not None:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_csv(df: DataFrame, path: str) -> None:
    """Writes CSV parts with a header, replacing older ones; quotes inside text are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="area_trends_")


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`.

    Only a local session may go without the setting; it then uses a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return base.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is removed when the driver ends."""
    folder = f"{shared_folder(spark)}/area_trends-{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder, which all executors share."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def scratch_paths() -> list[str]:
    """The paths in scratch space that were given out and not dropped, oldest first."""
    return list(_PATHS)


def drop_scratch(spark: SparkSession, paths: Sequence[str]) -> None:
    """Removes some of what was written to scratch space; frames that read it no longer work."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in _PATHS:
            _PATHS.remove(name)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that was written to scratch space; frames that read it no longer work."""
    folder = _own_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.discard(folder)
    _PATHS[:] = [p for p in _PATHS if not p.startswith(f"{folder}/")]


def materialise(df: DataFrame, name: str = "table", options: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """Writes the rows to shared scratch space, with these options of the Parquet writer, and reads them back.

    Cuts the lineage of a result used several times; lost executors do not lose it.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
