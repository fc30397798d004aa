"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), in any order and repeated or not -> (node long, root long) of every node that has
    an edge to another; root is the smallest node of its component and has a row itself. No edges: no rows.

    Every round joins edges with the smallest neighbour of each node, a count that is combined before the
    shuffle; a hub's edges are an ordinary skewed join that adaptive execution splits. Rounds end in the shared
    folder, so a lost executor costs one round.
    """
    cur = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Both sides of a join are plain tables, so that a hub's edges are split.
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = staged(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        unstage(low)
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = _signature(new)
        for x in (cur, low, large):
            unstage(x)
        cur = new
        if now == before:
            break
        before = now
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
