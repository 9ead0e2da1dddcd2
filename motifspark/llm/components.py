"""Connected components of an edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the least node it reaches.

    Each round is two joins with partial minimums and ends in a written table; the number
    of rounds grows with the logarithm of a component's diameter. An empty table gives an
    empty one; loops and repeated edges do no harm.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u is hung on u's least neighbour.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: u and its smaller neighbours are hung on the least of them.
        small = large.filter("a > b").distinct()
        low = small.groupBy("a").agg(F.min("b").alias("m"))
        hung = small.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(hung.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
