"""Connected components of an edge table, by joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewatch.llm.words import stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands the smallest of its neighbours and
    itself to the larger neighbours, then to all neighbours. Long chains halve, and a node with very
    many neighbours is only ever the key of a grouping or of a join that adaptive execution splits.
    """
    star = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges"
    )
    seen = None
    while (now := _fingerprint(star)) != seen:
        seen = now
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        large = stored(large, f"{label}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{label}-small")
    member = star.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component"))
    return member.unionByName(member.select(F.col("component").alias("node"), "component").distinct())
