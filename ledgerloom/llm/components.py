"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (a, b), both long; component is its smallest
    node. Self-links and repeated links are allowed; without links the result is empty.

    A star round is one minimum per node, pre-aggregated before its shuffle, and a join of
    the links with those minima. The hub of a large star is a hot key of that join: its other
    side has one row per node, so adaptive execution splits the hub's links over tasks."""
    links = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before = None
    for i in range(1, rounds + 1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        links = scratch.write(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links have not settled in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
