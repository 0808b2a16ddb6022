"""Connected components of links between classes, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that occurs in ``links`` (a, b).

    Each round links all larger neighbours of a node, and the node itself, to its smallest neighbour, and then all
    smaller ones likewise, until nothing changes. A round writes its links, so lineage stays short; the number of rounds grows
    with the logarithm of the largest component. Loops and repeated links do no harm; no links give an empty table.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _fingerprint(edges)
    while before[0]:
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        # larger node u keeps its smallest neighbour, the others are linked to that one
        joined = edges.join(low, "u")
        moved = joined.select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")).where("u <> v")
        large = moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        # smaller node v: its larger neighbours go to the smallest neighbour of v
        low_of_v = large.groupBy("u").agg(F.min("v").alias("root"))
        small = (
            large.join(low_of_v.withColumnRenamed("u", "v"), "v", "left")
            .select("u", F.coalesce("root", "v").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = materialize(small, "links")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of links and a sum of their hashes; equal when nothing has changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
