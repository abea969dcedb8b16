"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbrow.session import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of every node on the least node of its neighbourhood: the larger ones, or the others."""
    around = _both_ways(edges) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = around.join(least, F.col("a") == F.col("u"))
    if large:
        hung = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the label is the least node that can be reached.

    Ends when every node hangs on its label; the rounds grow with the logarithm of the size.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state, before = settle(ordered), None
    while True:
        state = settle(_star(_star(state, large=True), large=False))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = state.select("b").distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("label"))
    )
