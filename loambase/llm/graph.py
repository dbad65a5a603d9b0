"""Distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is named by its smallest node.

    Alternates large-star and small-star steps: a node's larger neighbours, then its smaller ones,
    move to the smallest node it sees, until only stars are left. A step keeps one minimum per node
    (combined before the shuffle) and never gathers a node's neighbours; a hub's rows stay on the
    join side that can be split. Every round is a table in the shared folder. No edges, no rows;
    loops and repeated edges count once.
    """
    now = materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(now.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        low = large.groupBy("child").agg(F.min("parent").alias("low"))
        small = large.join(low, "child").select(F.explode(F.array(F.struct("child", F.col("low").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("low").alias("parent")))).alias("e")).select("e.*")
        now = materialize(small.filter("child <> parent").distinct(), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(now.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct())
