"""Connected components of an edge list, without collecting links or components.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
hangs the neighbours of a node on the least of them, so trees flatten in a
logarithmic number of rounds and no node's neighbours need be in one task.
The least neighbour is pre-aggregated and given back to the edges by ``by_key``,
which spreads those of hubs; rounds end when no edge changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.hot import by_key
from lodegrid.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the component's least node. Nodes alone are absent."""
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    total = 2 * now.count()
    while True:
        # Large star: the neighbours above a node hang on the least of it and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("key_rows")).select("a", F.least("a", "m").alias("m"), "key_rows")
        large = by_key(both, least, "a", total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the neighbours below a node, and itself, hang on the least of them.
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("key_rows"))
        small = by_key(down, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = scratch.table(small.where("a <> b").distinct(), "edges")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        scratch.drop(now)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
