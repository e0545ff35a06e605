"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.session import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(node, root)`` for every node of ``edges``; the root is the smallest reachable node.

    Edges hold two ``bigint`` node numbers. Self loops and rows with a null end are ignored, and
    repeated or reversed edges count once. Each round lets every node tell its larger neighbours,
    and then all its smaller ones, of the smallest node it knows. Minima combine on the map side,
    so a hub is one row per task; the two joins carry no order, so a hot node's rows may be split.
    Every round is written to the shared folder: a lost executor repeats one round at most.
    """
    e = durable(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        e = durable(small.distinct())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free checksum; equal marks mean that a round changed nothing."""
    row = edges.select(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]
