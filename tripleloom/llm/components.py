"""Connected components of a graph of integer ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import discard, stored


def _with_least(sided: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, u itself included."""
    least = sided.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return sided.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = down.select(F.col("v").alias("u"), F.col("least").alias("v"))
    kept = down.select("u", F.col("least").alias("v"))
    return moved.union(kept).where("u != v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every id in ``edges`` (columns u, v) that is not the smallest of its component.

    Every round is written to the shared folder, in place of the one before; rounds grow with the logarithm of the longest chain. The least
    neighbour is an aggregate that combines before the shuffle, and each edge meets it in an ordinary join, so a node
    with very many edges is not gathered anywhere. Self links and repeated edges do no harm; no edges give no rows.
    """
    edges = stored(edges.select("u", "v").where("u != v").distinct(), label)
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
        before, edges = edges, stored(_small_star(_large_star(edges)), label)
        discard(before)
