"""Connected components of an edge table by alternating large-star and small-star rounds.

Every step is an aggregation with partial sums and an equi-join, so no neighbourhood is collected and a hub's edges can
be split among tasks. Nothing reaches the driver but a count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: (node, other, up), up where the node is the larger end."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), F.lit(0).alias("up"))))
    return edges.select(ends.alias("e")).select("e.*")


def _outside_stars(edges: DataFrame) -> int:
    """Nodes with several smaller neighbours, or with smaller and larger ones; without any, each edge leads to its root."""
    up, down = F.sum("up"), F.sum(1 - F.col("up"))
    return _both(edges).groupBy("node").agg(up.alias("u"), down.alias("d")).where("u > 1 or (u > 0 and d > 0)").count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``, component the smallest id reachable; without lone nodes.

    The rounds needed grow with the logarithm of the longest path; ``max_rounds`` without convergence is an error."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    for _ in range(max_rounds):
        if not _outside_stars(edges):
            break
        last = edges
        # large star: of u's neighbours v > u, each is tied to the least of u and its neighbours
        least = _both(edges).groupBy("node").agg(F.min("other").alias("m")).select(F.col("node").alias("u"), F.least("node", "m").alias("m"))
        large = edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).where("a <> b")
        # small star: u and its smaller neighbours are tied to the least of them
        lower = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = lower.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        tied = lower.join(least, F.col("a") == F.col("u"))
        small = tied.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        drop_written(last)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    star = edges.groupBy("a").agg(F.min("b").alias("b"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        star.select("b", "b").distinct()
    )
