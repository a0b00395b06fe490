"""Connected components of a graph given as a DataFrame of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (its larger ones, or the node and its smaller ones) to the least of them.

    The least neighbour is a pre-aggregated minimum; hot nodes meet it again in an equi-join, which AQE
    splits, so no node's neighbours are gathered in one task.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    `edges` has columns a and b. Each round is cut off by a checkpoint in the shared folder.
    """
    edges, before = checkpoint(edges.where("a <> b")), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        edges = checkpoint(_star(_star(edges, True), False))
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
