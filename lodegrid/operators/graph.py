"""Bounded traversal of the typed multigraph, by rounds that look up the steps of a frontier.

A traversal ends at ``limit`` nodes, so the nodes that a round expands are fewer than that:
they go into the filter of the next scan, where they prune what is read.  ``Adjacency``
stores steps by the node that they leave from, so that a round reads the frontier's buckets alone.
Edges of which an end is null are no steps; repeated edges and loops change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES = 10, 1000
#: Steps in a bucket, near enough, and buckets at most: beyond that they grow, and the order of steps in their files prunes.
BUCKET_STEPS, MAX_BUCKETS = 1_000_000, 8_192
DIRECTIONS = ("outbound", "inbound", "both")


def directed(edges: DataFrame, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
    """Steps (src, dst) of a traversal: undirected ones as two, so that each round is an equi-join."""
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(*edge_types))
    out = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return {"outbound": out, "inbound": back}.get(direction, out.unionByName(back))


def walk(root: str, around: Callable[[list[str]], DataFrame], spark: SparkSession, depth: int, limit: int) -> DataFrame:
    """(id, hop): nodes within ``depth`` steps of the root (itself at hop 0), the nearest ``limit`` of them, ties by id.

    ``around`` gives the nodes (dst) that steps lead to from some.  A node is expanded once, however
    many paths lead there.  The driver holds the ids of the answer, at most ``limit``; hubs with
    any number of neighbours are put in order by Spark, and only what the answer has room for comes back.
    """
    hops, frontier = {root: 0}, [root]
    for hop in range(1, min(depth, MAX_DEPTH) + 1):
        room = limit - len(hops)
        if room <= 0 or not frontier:
            break
        found = around(frontier).where(F.col("dst").isNotNull() & ~F.col("dst").isin(*hops)).distinct().orderBy("dst").limit(room)
        frontier = [r["dst"] for r in found.collect()]
        hops |= dict.fromkeys(frontier, hop)
    return spark.createDataFrame(list(hops.items()), "id string, hop int").orderBy("hop", "id").limit(limit)


def reach(root: str, edges: DataFrame, depth: int = 2, direction: str = "both", edge_types: list[str] | None = None, limit: int = MAX_NODES) -> DataFrame:
    """``walk`` over edges as they are: each round scans them with the frontier as a filter."""
    steps = directed(edges, direction, edge_types)
    return walk(root, lambda ids: steps.where(F.col("src").isin(*ids)).select("dst"), edges.sparkSession, depth, limit)


class Adjacency:
    """Steps of a graph, stored by the node that they leave from.

    Each edge is two steps, one of each direction.  A step's bucket is the CRC-32 of the node it leaves from;
    within a bucket steps are ordered by it and by where they lead, so a hub is dealt to as many tasks and files as it needs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.steps = spark, spark.read.parquet(path)
        first = self.steps.select("buckets").first()
        self.buckets = first["buckets"] if first else 1

    @classmethod
    def write(cls, edges: DataFrame, path: str, buckets: int | None = None) -> Adjacency:
        ends = edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        n = buckets or min(MAX_BUCKETS, max(1, -(-2 * ends.count() // BUCKET_STEPS)))
        ways = F.array(
            F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lit(True).alias("forward")),
            F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), F.lit(False).alias("forward")),
        )
        steps = ends.select("edge_type", F.explode(ways).alias("step")).select("step.*", "edge_type").distinct()
        placed = steps.withColumns({"buckets": F.lit(n), "bucket": cls._bucket(F.col("src"), n)})
        order = ["bucket", "src", "dst"]
        dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).write
        # Without a step there is no bucket, and a file has to keep the columns.
        (placed.write if ends.isEmpty() else dealt.partitionBy("buckets", "bucket")).parquet(path)
        return cls(edges.sparkSession, path)

    @staticmethod
    def _bucket(src: Column, n: int) -> Column:
        return (F.crc32(src) % n).cast("int")

    def around(self, ids: list[str], direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
        """Nodes (dst) that steps lead to from some nodes; only the buckets of those are read."""
        steps = self.steps.where(F.col("bucket").isin(*{zlib.crc32(x.encode()) % self.buckets for x in ids}) & F.col("src").isin(*ids))
        if direction != "both":
            steps = steps.where(F.col("forward") == F.lit(direction == "outbound"))
        return (steps.where(F.col("edge_type").isin(*edge_types)) if edge_types else steps).select("dst")

    def reach(self, root: str, depth: int = 2, direction: str = "both", edge_types: list[str] | None = None, limit: int = MAX_NODES) -> DataFrame:
        """``walk`` over the stored steps."""
        return walk(root, lambda ids: self.around(ids, direction, edge_types), self.spark, depth, limit)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges, of all types, with both ends among the nodes (id)."""
    near = ids.select("id")
    return edges.join(near, edges["source_id"] == near["id"], "left_semi").join(near, edges["target_id"] == near["id"], "left_semi")


def search(root: str, nodes: DataFrame, edges: DataFrame, depth: int = 2, edge_types: list[str] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame] | None:
    """Nodes around a root, with their hop, and the edges among them; None if there is no such root."""
    if nodes.where(F.col("id") == root).isEmpty():
        return None
    near = reach(root, edges, depth, direction, edge_types)
    return nodes.join(near, "id").orderBy("hop", "id"), induced(edges, near)
