"""Exact quantiles of groups of any size, by counting values in ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import materialise
from .joins import lookup_join

BUCKETS = 1024
SMALL = 10_000


def _bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """0 for the low end, 1 .. buckets for what lies between in order, buckets + 1 for the high end.

    Halves keep differences of large numbers finite; between infinite ends there is one bucket.
    """
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    inner = F.when(F.isnan(share), 0).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    return F.when(value <= low, 0).when(value >= high, buckets + 1).otherwise(inner + 1).cast("int")


def rank_values(
    values: DataFrame,
    keys: Sequence[str],
    ranks: DataFrame,
    small: int = SMALL,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Adds `v`, the value of each rank (from 0), to ranks (keys, rank, low, high, below, n).

    `values` holds the keys and `v`, without null and NaN. A rank's value lies among the `n` values
    from `low` to `high`, and `below` values are less than `low`. Each round counts the values
    between in ranges, which combine map-side, and narrows to the range that holds the rank; ends stand
    apart, so every round gets closer. Ranges of up to `small` values are sorted at last.
    """
    group = F.struct(*keys).alias("_group") if keys else F.lit(0).alias("_group")
    values = values.select(group, "v")
    rest = materialise(ranks.withColumn("_group", group), "ranks")
    done = None
    while True:
        known = rest.where("low = high").withColumn("v", F.col("low"))
        done = known if done is None else done.unionByName(known)
        last = rest.where(f"low < high AND n <= {small}")
        done = done.unionByName(_sorted(values, last))
        rest = rest.where(f"low < high AND n > {small}")
        if rest.isEmpty():
            return done.drop("_group")
        ranges = rest.select("_group", "low", "high").distinct()
        inside = lookup_join(values, ranges, "_group").where("v >= low AND v <= high")
        bucket = _bucket(F.col("v"), F.col("low"), F.col("high"), buckets)
        counts = inside.groupBy("_group", "low", "high", bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most")
        )
        before = F.sum("m").over(W.partitionBy("_group", "low", "high").orderBy("bucket")) - F.col("m")
        counts = counts.withColumn("before", before)
        found = rest.join(counts, ["_group", "low", "high"])
        place = F.col("rank") - F.col("below")
        found = found.where((place >= F.col("before")) & (place < F.col("before") + F.col("m")))
        rest = found.select(
            *keys,
            "rank",
            F.col("least").alias("low"),
            F.col("most").alias("high"),
            (F.col("below") + F.col("before")).alias("below"),
            F.col("m").alias("n"),
            "_group",
        )
        rest = materialise(rest, "ranks")


def _sorted(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """The values of ranks whose range holds few: different values counted and summed in order."""
    ranges = ranks.select("_group", "low", "high").distinct()
    inside = lookup_join(values, ranges, "_group").where("v >= low AND v <= high")
    counts = inside.groupBy("_group", "low", "high", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy("_group", "low", "high").orderBy("v"))
    counts = counts.withColumns({"upto": upto})
    place = F.col("rank") - F.col("below")
    found = ranks.join(counts, ["_group", "low", "high"])
    found = found.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("m")))
    return found.select(*ranks.columns, "v")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Sequence[float] = (0.25, 0.5, 0.75),
    small: int = SMALL,
    buckets: int = BUCKETS,
) -> DataFrame:
    """keys, n (values) and q (array): the quantiles of each group, interpolated between ranks.

    Null and NaN are no values; a group without any has none. Equal to sorting each group, but no
    task holds a group: a round of counting makes at most `buckets` + 2 rows per task, group and
    range, and each of the two ranks of a quantile has one range. Give stored rows, as each
    round reads them; groups of up to `small` values need one pass after the first.
    """
    v = F.col(f"`{value}`").cast("double")
    held = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + F.lit(0.0)).alias("v"))
    groups = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    groups = materialise(groups.where("n > 0"), "groups")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    wanted = groups.withColumn("s", at).withColumn("at", F.col("s.share") * (F.col("n") - 1))
    wanted = wanted.select(*keys, F.col("s.i").alias("i"), "at", "n", "low", "high")
    ends = F.explode(F.array(F.floor("at"), F.ceil("at")))
    ranks = wanted.select(*keys, "low", "high", "n", ends.alias("rank")).distinct()
    ranks = ranks.select(*keys, "rank", "low", "high", F.lit(0).cast("long").alias("below"), "n")
    found = rank_values(held, keys, ranks, small, buckets).select(*keys, "rank", "v")
    ranked = wanted.select(*keys, "i", "at", "n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"))
    pairs = _null_safe(ranked, found, [*keys, "rank"])
    both = pairs.groupBy(*keys, "n", "i").agg(
        F.min("v").alias("a"), F.max("v").alias("b"), F.max(F.col("at") - F.floor("at")).alias("part")
    )
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    )
    # there are as many quantiles as shares
    q = F.transform(F.sort_array(F.collect_list(F.struct("i", between.alias("v")))), lambda x: x["v"])
    return both.groupBy(*keys, "n").agg(q.alias("q"))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal; the keys of the left side stay."""
    named = right.toDF(*[f"_{c}" if c in keys else c for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_{k}"])
    return left.join(named, same).drop(*[f"_{k}" for k in keys])
