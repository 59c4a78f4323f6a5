"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).head())


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """pairs (v, u): v joined with the smallest of itself and its partners."""
    least = pairs.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    return pairs.join(least, "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b): root is the smallest node of its component.

    Both steps aggregate minima before they join, so a node with many edges is
    combined map-side and its join can be split by adaptive execution.
    Edges are written to the shared folder after each round. Null ends and
    loops are ignored; repeated edges count once.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        large = _toward_minimum(both).where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = _toward_minimum(large.select(F.col("a").alias("v"), F.col("b").alias("u")))
        small = down.select(F.col("u").alias("a"), F.col("m").alias("b")).union(down.select(F.col("v").alias("a"), F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
