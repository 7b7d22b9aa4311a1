"""Connected components of a graph of any size: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockmetrics.sources.stored import store

ROUNDS = 64


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours are hung on the smallest of them; groups are joined, never gathered."""
    if small:
        pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    else:
        pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Adaptive execution splits the partition of a node with very many neighbours.
    joined = pairs.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least.select("u", "m"))
    else:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return moved.filter(F.col("src") != F.col("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of (src, dst), itself included.

    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = store(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        edges = store(_star(_star(edges, small=False), small=True), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("dst").alias("node")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
