"""Property paths: ``p+`` and ``p*``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_root


def path_closure(
    edges: DataFrame,
    sources: DataFrame | None = None,
    include_start: bool = False,
    max_rounds: int | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """``(start, node)`` for every node that edges ``(source, target)`` lead to.

    Each round takes only the pairs that the last one found new and follows one
    more edge, so cycles end and no edge is followed twice from the same pair.
    Rounds are cut off by reliable checkpoints, which survive lost executors.
    ``include_start`` adds the path of length zero. Raises ``RuntimeError`` if
    ``max_rounds`` do not reach the end.

    Name the bound end: with ``sources(start)`` only ways from them are walked, with ``targets(node)`` only ways to
    them, backwards. Where neither is bound, :func:`.condensation.path_components` gives the same answer without
    listing the pairs of nodes.
    """
    if targets is not None:
        if sources is not None:
            raise ValueError("bind one end; filter the result for the other")
        turned = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
        ends = targets.select(F.col("node").alias("start"))
        found = path_closure(turned, ends, include_start, max_rounds)
        return found.select(F.col("node").alias("start"), F.col("start").alias("node"))
    spark = edges.sparkSession
    scratch_root(spark)
    links = edges.select("source", "target").distinct().checkpoint()
    starts = links if sources is None else links.join(
        sources.select(F.col("start").alias("source")).distinct(), "source", "left_semi"
    )
    frontier = starts.select(F.col("source").alias("start"), F.col("target").alias("node")).checkpoint()
    # Pairs found so far are kept per round: a pair is new if no earlier round has it.
    found = frontier
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"paths go on after {max_rounds} rounds")
        reached = (
            frontier.join(links, frontier["node"] == links["source"])
            .select("start", F.col("target").alias("node"))
            .distinct()
        )
        frontier = reached.join(found, ["start", "node"], "left_anti").checkpoint()
        found = found.unionByName(frontier)
    if include_start:
        if sources is not None:
            ends = sources.select("start").distinct()
        else:
            ends = links.select(F.explode(F.array("source", "target")).alias("start")).distinct()
        found = found.unionByName(ends.select("start", F.col("start").alias("node"))).distinct()
    return found
