"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of ``links`` (a long, b long) the smallest node it is connected with.

    Nodes without links are not in the result. Each round groups by node with partial
    minima before the shuffle and is written to the shared folder; rounds end when the
    edges no longer change. Empty input gives an empty result; loops and repeats don't matter.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = _sign(edges)
    while True:
        large = _star(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger_only=True)
        small = staged(_star(large, larger_only=False))
        new = _sign(small)
        edges = small
        if new == sign:
            break
        sign = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Joins each node's neighbours to the smallest of them and itself."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = edges.join(least, "u")
    if larger_only:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()
