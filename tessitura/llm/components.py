"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so nothing gathers a component in one task or on the driver; a node with very
many links is a skewed join key, which adaptive execution splits. Every round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.shared import discard, written


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Links (u, v) of each node's larger, or not larger, neighbours to its smallest neighbour or itself."""
    near = links.select("u", "v") if not larger else links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if larger:
        near = near.where("v > u")
    joined = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        joined = joined.union(least.select("u", F.col("m").alias("v")))
    return joined.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) for every node that has a link, the component being its smallest node. Order and repetition of
    links don't matter; links with a null end or to oneself are left out. Raises if `most` rounds aren't enough."""
    ends = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v and u is not null")
    now = written(ends.select("u", "v").distinct(), name)
    seen = None
    for _ in range(most):
        after = written(_stars(_stars(now, True), False), name)
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
