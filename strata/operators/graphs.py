"""Layered traversal with stop rules, and node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


@dataclass
class Walk:
    reached: DataFrame
    layers: int
    stop: str


def layers(edges: DataFrame, seeds: DataFrame, max_layers: int = 4, max_found: int = 200) -> Walk:
    """Breadth-first over (a, b) edges from seeds (a): (node, layer) of all that is reached.

    A layer is an anti-join of the frontier's targets with what was seen before. Stops, in
    this order and looked at before a layer begins, so the size may overshoot: depth, size,
    nothing new. Each layer is written out, so lineage doesn't grow.
    """
    edges = written(edges.select("a", "b"), "walk-edges")
    frontier = written(seeds.select(F.col("a").alias("node")).where("node is not null").distinct().withColumn("layer", F.lit(0)), "walk")
    seen, found, layer = frontier, frontier.count(), 0
    while True:
        if layer >= max_layers:
            return Walk(seen, layer, "depth_cap")
        if found >= max_found:
            return Walk(seen, layer, "size_cap")
        nxt = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).where("node is not null").distinct()
        nxt = written(nxt.join(seen.select("node"), "node", "left_anti").withColumn("layer", F.lit(layer + 1)), "walk")
        n = nxt.count()
        if n == 0:
            return Walk(seen, layer, "frontier_exhausted")
        layer, found, frontier = layer + 1, found + n, nxt
        seen = seen.unionByName(nxt)


def node_edge(tables: list[tuple[DataFrame, str, str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (src, dst, relation) of (table, src, src kind, dst, dst kind, relation), each once; the smallest kind wins."""
    nodes = edges = None
    for df, src, src_kind, dst, dst_kind, relation in tables:
        e = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(relation).alias("relation"))
        n = df.where(F.col(src).isNotNull()).select(F.col(src).cast("string").alias("id"), F.lit(src_kind).alias("kind"))
        n = n.unionByName(df.where(F.col(dst).isNotNull()).select(F.col(dst).cast("string").alias("id"), F.lit(dst_kind).alias("kind")))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes.groupBy("id").agg(F.min("kind").alias("kind")), edges.distinct()
