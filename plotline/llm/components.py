"""Distributed union-find: connected components by alternating large-star and small-star rounds.

Each round replaces edges by edges to smaller neighbours (one grouped minimum and one join per star), so a
component ends as a star around its smallest node after a logarithmic number of rounds. Edges stay in
DataFrames; a hot node's neighbours are reduced by partial aggregation, and its join side is split by
adaptive skew handling because the other side has one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import drop_written, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u points to the smallest node around u."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31)).alias("h")).first()
    return row.n, row.h or 0


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Components of an undirected graph of long nodes.

    Returns (node, root): one row per node that has a link to another node; root is the smallest node of its
    component. Null ends, self links and repeated links are ignored; no links give an empty table.
    """
    stars = materialise(
        edges.filter(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct(), "edges")
    mark = _mark(stars)
    while mark[0]:
        turned = materialise(_small_star(_large_star(stars)), "edges")
        now = _mark(turned)
        drop_written(stars)
        stars = turned
        if now == mark:
            break
        mark = now
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
