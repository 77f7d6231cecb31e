"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from area_trends.sources.tables import materialise


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b).

    Each round gives a node the smallest label among its neighbours and then the label
    of that label, until nothing changes. Labels are written to shared scratch space
    after each round; the driver sees one count.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"))
    labels = materialise(labels.withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("via")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        after = materialise(
            lower.join(jump, "via").select("node", "old", F.least("via", "beyond").alias("component")), "labels"
        )
        labels = after.drop("old")
        if after.where(F.col("old") != F.col("component")).isEmpty():
            return labels


class Verifier:
    """Tells which candidate pairs are linked; no pair is looked at twice."""

    def __init__(self):
        self.seen: DataFrame | None = None

    def check(self, pairs: DataFrame) -> DataFrame:
        """The linked ones (a, b) of distinct pairs."""
        raise NotImplementedError

    def features(self) -> DataFrame:
        """node and `features`: something of a small, fixed size to tell most unlike pairs by."""
        raise NotImplementedError

    def may_link(self, a: Column, b: Column) -> Column:
        """Whether the features of two nodes allow a link; true for every linked pair."""
        raise NotImplementedError

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of those pairs that were not seen before."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        self.seen = pairs if self.seen is None else self.seen.union(pairs)
        return materialise(self.check(pairs), "links")


def link_members(members: DataFrame, verifier: Verifier) -> DataFrame:
    """Links that connect whatever all pairs within the keys (key, node, low) would connect.

    First every member of a key is compared with its smallest one, then, where a key
    still holds several components, with its best-linked one; only members of different
    components that share a key are then compared with each other, as far as their
    features allow a link. So a large group of near copies costs a comparison or two per key and
    member, and members that are unlike each other are told apart inside the join.
    """
    first = members.where(F.col("node") != F.col("low")).select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = verifier.links(first)

    def open_keys() -> DataFrame:
        named = components(links)
        held = members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        return materialise(held.join(several.where("x < y").select("key"), "key"), "open_keys")

    held = open_keys()
    ends = links.select("a").union(links.select("b"))
    degree = ends.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    best = (
        held.join(degree, "node", "left")
        .groupBy("key")
        .agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "node", "component")).alias("best"))
        .select("key", F.col("best.node").alias("a"), F.col("best.component").alias("other"))
    )
    second = held.join(best, "key").where(F.col("component") != F.col("other")).select("a", F.col("node").alias("b"))
    links = materialise(links.union(verifier.links(second)), "links")
    held = materialise(open_keys().join(verifier.features(), "node"), "open_features")
    left, right = (
        held.select("key", F.col("node").alias(n), F.col("component").alias(side), F.col("features").alias(f"of_{n}"))
        for n, side in (("a", "left"), ("b", "right"))
    )
    # part of the join's condition, so pairs that cannot link are never rows
    able = verifier.may_link(F.col("of_a"), F.col("of_b"))
    rest = left.join(right, "key").where((F.col("left") < F.col("right")) & able).select("a", "b")
    return materialise(links.union(verifier.links(rest)), "links")
