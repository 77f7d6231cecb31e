"""Snapshots of a table in one folder per date: the one as of a day, and what changed between two."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_dates(spark: SparkSession, path: str, column: str = "archived_on") -> list[str]:
    """The dates that have a folder, in order, from the names of the folders alone."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
    values = [unquote(n.removeprefix(f"{column}=")) for n in names if n.startswith(f"{column}=")]
    return sorted(v for v in values if _is_date(v))


def _is_date(text: str) -> bool:
    try:
        return dt.date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def snapshot_as_of(spark: SparkSession, path: str, day: str, column: str = "archived_on") -> DataFrame:
    """The newest snapshot not after a day; only its folder is read.

    Folders without a date are no snapshots. Raises if there is no snapshot by that day.
    """
    dt.date.fromisoformat(day)
    held = [d for d in snapshot_dates(spark, path, column) if d <= day]
    if not held:
        raise ValueError(f"no snapshot on or before {day}")
    return spark.read.parquet(path).where(F.col(column).cast("string") == held[-1])


def snapshot_difference(
    old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """keys and change: `added`, `removed` or `changed`, for every key whose rows differ.

    Rows are compared by all other columns of `old` (or by `columns`) through a 64-bit hash
    that tells a null from any value and its place. A key may have several rows: it is unchanged when both sides
    hold the same ones equally often. Keys are equal where null. One shuffle of keys and hashes: rows of both
    sides are tagged, and counted and summed per key, map-side first.
    """
    rest = [c for c in (old.columns if columns is None else columns) if c not in keys]
    parts = [p for c in rest for p in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    mark = F.xxhash64(*parts, F.lit(0)).cast("decimal(20,0)")
    sides = [
        df.select(*keys, mark.alias("mark"), F.lit(side).alias("side")) for side, df in ((0, old), (1, new))
    ]
    both = sides[0].unionByName(sides[1])
    held = both.groupBy(*keys).agg(
        *[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)],
        *[F.sum(F.when(F.col("side") == s, F.col("mark"))).alias(f"sum{s}") for s in (0, 1)],
        # a second measure, so that different rows do not pass by adding up to the same sum
        *[F.bit_xor(F.when(F.col("side") == s, F.xxhash64("mark", F.lit(1)))).alias(f"xor{s}") for s in (0, 1)],
    )
    same = (F.col("n0") == F.col("n1")) & (F.col("sum0") == F.col("sum1")) & (F.col("xor0") == F.col("xor1"))
    change = F.when(F.col("n0") == 0, "added").when(F.col("n1") == 0, "removed").when(~same, "changed")
    return held.select(*keys, change.alias("change")).where("change IS NOT NULL")
