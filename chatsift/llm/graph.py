"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import discard, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, wanted: DataFrame, total: int) -> DataFrame:
    """The wanted edges (u, v) with the smallest neighbour m of u in edges.

    Nodes with more than a thousandth of all edges (of which there are two thousand
    at most) meet theirs by broadcast, so that no star is joined in one task.
    """
    many = max(100, total // 1000)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    crowded = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
    few = least.where(F.col("n") <= many).select("u", "m")
    return wanted.join(crowded, "u").select("u", "v", "m").union(
        wanted.join(crowded, "u", "left_anti").join(few, "u").select("u", "v", "m"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = _both(edges)
    return _stars(both, both.where("v > u"), total).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    below = _stars(down, down, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(down.groupBy("u").agg(F.min("v").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (u, v); label: the smallest node it is connected with.

    Each round is a table in the shared folder, in place of the one before; rounds grow
    with the logarithm of the longest path and end once all links are stars: no node
    points at two others, none that points is pointed at. No links: an empty table.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(False).alias("met")).union(
            edges.select("v", F.lit(0), F.lit(True)))
        state = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("met").alias("met")).agg(
            F.sum("up").alias("total"), F.max(F.expr("up > 1 or up = 1 and met")).alias("more")).first()
        if not state.more:
            break
        last = edges
        edges = staged(_small(_large(last, state.total), state.total).where("u <> v").distinct(), "links")
        discard(last)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
