"""Connected components by alternating stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import written


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges (a, b)``; the root is the smallest node that can be reached.

    Each round points the larger neighbours of a node to its smallest neighbour, then the smaller ones and the node
    itself. The number of rounds grows with the logarithm of the longest path; the driver sees only a checksum of a round.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _checksum(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # A node that is the smallest of its neighbourhood keeps its own edges through them.
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        edges = written(small.where("a <> b").distinct(), "edges")
        before, mark = mark, _checksum(edges)
        if before == mark:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()


def _checksum(edges: DataFrame) -> tuple[int, int]:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), F.coalesce(total, F.lit(0))).first())
