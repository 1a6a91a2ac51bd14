"""Connected components of an edge table, as alternating star contractions.

Every round replaces the neighbours of a node by links to their smallest member. The edges live in written tables, nothing is
collected but one pair of sums per round. The minimum of a hub is formed map-side, and its links are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One contraction. edges: u > v, no loops. large: larger neighbours move to the minimum; else smaller ones do."""
    if large:
        met = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = met.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("u", "m"))
    else:
        met = edges
        least = met.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    joined = spread_join(met, least.drop("_n"), "u", counts=least.select("u", "_n"), total=2 * total)
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Each node of `edges` (u, v; any order, loops and repeats allowed; nulls ignored) with the smallest node it can reach.

    Returns node, component. An empty table gives an empty one. Rounds grow with the logarithm of the longest path.
    """
    kept = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    kept = stored(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _fingerprint(kept)
    for _ in range(max_rounds):
        if not before[0]:
            break
        kept = stored(_star(kept, large=True, total=before[0]), "edges")
        kept = stored(_star(kept, large=False, total=before[0]), "edges")
        after = _fingerprint(kept)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = kept.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
