"""Connected components of links between long ids, by alternating large-star and small-star steps.

Each step hands a node's neighbours to its least neighbour: a grouping and a join by node id, the join's hot nodes split
by adaptive execution. Rounds grow with the logarithm of the longest chain. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _to_least(links: DataFrame, small: bool) -> DataFrame:
    """links: (u, v) with u > v. Large star: larger neighbours go to the least of all; small star: smaller ones and u do."""
    if small:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        met = links.join(least, "u")
        return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node of its component. Self-links are ignored."""
    scratch = common.Scratch(links.sparkSession, "components")
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = scratch.keep(pairs, "round-0")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = pairs.agg(F.count(F.lit(1)), mark).first()
    for k in range(1, most_rounds + 1):
        if not before[0]:
            break
        pairs = scratch.keep(_to_least(_to_least(pairs, small=False), small=True), f"round-{k}")
        now = pairs.agg(F.count(F.lit(1)), mark).first()
        scratch.drop(f"round-{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
