"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def checksum(edges: DataFrame) -> tuple:
    """The number of edges (u, v) and a sum of their hashes that can't overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge and the smallest node it can reach.

    Each round joins the edges with each node's smallest neighbour; hubs are split by adaptive skew
    handling, since both sides of the join are plain exchanges. Edges are written to the shared
    folder after every round.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, last = scratch.save(now, "0"), None
    if now.isEmpty():
        return now.toDF("node", "root")
    for i in range(1, MAX_ROUNDS):
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        now = scratch.save(small, str(i))
        state = checksum(now)
        scratch.drop(str(i - 1))
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
