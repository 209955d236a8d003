"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Only equi-joins and partial aggregations: no neighbour list is ever gathered, so a hub with any number of leaves
costs rows, not memory, and AQE can split it.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """``edges(u, v)`` of one orderable type -> ``(node, root)``, root the least node reachable.

    Nodes without an edge to another node do not appear; loops, repeats and direction do not matter; an edge with a
    null end is no edge.  ``rows``: there are no more edges than these.  ``scratch.drop`` takes the result.
    """
    now = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges", rows
    )
    before = _digest(now)
    while before[0]:  # neither step makes more edges than it is given
        both = now.selectExpr("hi AS u", "lo AS v").union(now.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.save(large, "large", before[0])
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(roots, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = scratch.save(moved.union(roots.selectExpr("hi", "m AS lo")).distinct(), "small", before[0])
        scratch.drop(now, large)
        now, after = small, _digest(small)
        if after == before:
            break
        before = after
    stars = now.selectExpr("hi AS node", "lo AS root")
    stars._scratch_path = now._scratch_path
    return stars


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table: equal twice running means that the stars are final."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return (row[0], row[1])
