"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = materialize(low, "low")  # a table of its own, so that AQE can split a hub's links in the join
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) of every node of ``edges`` (u, v: bigint) but the roots: root is the smallest node
    that u reaches.

    Self-links and nulls are left out; direction and repeats do not matter. Each round is written
    to the checkpoint folder; links of hub nodes are aggregated before the shuffle and their join
    is split by AQE. Raises if ``max_rounds`` rounds do not settle (they shrink as log^2 of nodes).
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def state(e: DataFrame):
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return row[0], row[1]

    before = state(now)
    if before[0] == 0:
        return now.select("u", F.col("v").alias("root"))
    for _ in range(max_rounds):
        now = materialize(_small_star(materialize(_large_star(now), "large")), "stars")
        after = state(now)
        if after == before:
            return now.select("u", F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
