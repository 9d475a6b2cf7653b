"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm._common import few, written


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rows: int = 1 << 62) -> DataFrame:
    """Edges (a, b) of longs to rows (node, root) for each node but the roots; a root is its component's least node.

    A round links every node to the least of its neighbours; its cost follows the number of edges, and nodes with very
    many edges are aggregated before the shuffle and split by skew joins. rows: about how many edges there are, if known.
    """
    edges = written(few(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows), "edges")
    before = _signature(edges)
    while before[0]:
        small = lambda df: few(df, 2 * before[0])  # noqa: B023, E731  a round leaves no more edges than it found
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = small(both.groupBy("a").agg(F.min("b").alias("m"))).select("a", F.least("a", "m").alias("m"))
        large = small(small(both.join(least, "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: a's smaller neighbours and a itself go to the least of them
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = small(large.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small(moved.where("a <> b").distinct()), "edges")
        now = _signature(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
