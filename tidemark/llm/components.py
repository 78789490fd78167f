"""Connected components by alternating large-star and small-star steps over stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, looked_up, stored


def _large(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return looked_up(both, least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = looked_up(edges, least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.unionByName(least.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a < b, LONG) to ``(node, component)`` for each node with an edge; the component is
    its smallest node.

    Each round is two shuffles of the edges; the number of rounds is about the logarithm of the
    largest component's size. A round's result is written to the shared folder. Empty edges give an
    empty result. An edge given twice, or in another order, changes nothing.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    for _ in range(rounds):
        # a forest of stars: no node is both a centre and a leaf, and no leaf has two centres
        flags = now.groupBy("b").agg(F.count("*").alias("n"))
        unfinished = not flags.where("n > 1").isEmpty() or not now.join(flags.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        if not unfinished:
            break
        nxt = stored(_small(_large(now).where("a < b").distinct()).where("a < b").distinct(), "edges")
        discard(now)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
