"""Changes to stored graphs: only the graphs touched are written again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path, scratch_root
from ..sources.graphs import clear_graphs, publish_graphs, read_graphs
from ..vocab import TRIPLE_COLUMNS
from .graph import Pattern, bgp_join, construct, delete_data, insert_data, join_triples


def update_graphs(
    spark: SparkSession, path: str, graphs: list[str], change: Callable[[DataFrame], DataFrame]
) -> None:
    """Apply ``change`` to the named graphs of a store.

    ``change`` gets the named graphs only and gives their new state. What it
    gives for other graphs is added to them; nothing they hold is lost. Named
    graphs that end up empty are removed.

    The new state is staged beside the store, so a job that fails before it is
    complete leaves the store as it was. Publishing then takes three steps
    (replace, add, clear); if one of them fails, running the update again from
    the same graphs finishes it, as each of them gives the same when repeated.
    """
    before = read_graphs(spark, path).where(F.col("graph").isin(graphs))
    staged = scratch_path(spark, "graph-update")
    change(before).select(*TRIPLE_COLUMNS).distinct().write.partitionBy("graph").parquet(staged)
    after = read_graphs(spark, staged)
    own = after.where(F.col("graph").isin(graphs))
    publish_graphs(own, path, is_set=True)
    insert_into(spark, path, after.where(~F.col("graph").isin(graphs)))
    clear_graphs(spark, path, graphs, keep=own)
    remove_path(spark, staged)


def update_where(
    spark: SparkSession, path: str, graph: str, where: Sequence[Pattern], delete: Sequence[Pattern] = (), insert: Sequence[Pattern] = ()
) -> None:
    """DELETE/INSERT … WHERE on one stored graph: templates filled from the solutions of the patterns.

    Deletions and insertions see the graph as it was; deletions come first.
    """

    def change(before: DataFrame) -> DataFrame:
        named = {term[1:] for p in (*delete, *insert) for _, term in p.cells() if isinstance(term, str) and term.startswith("?")}
        solutions = bgp_join(before, where, typed=named & {name for p in where for name in p.variables()})
        after = before
        if delete:
            after = delete_data(after, construct(solutions, delete, graph))
        return insert_data(after, construct(solutions, insert, graph)) if insert else after

    update_graphs(spark, path, [graph], change)


def insert_into(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Add triples to stored graphs without writing again what they hold.

    What a graph has of the new triples is looked up from its side, so a small
    insert is broadcast to the graph's files and moves none of its rows. The
    store is first joined with the names of the graphs concerned on its
    partition column: only their partitions are read, however many they are.
    """
    scratch_root(spark)
    added = new.select(*TRIPLE_COLUMNS).distinct().checkpoint()
    concerned = added.select("graph").distinct()
    stored = read_graphs(spark, path).join(concerned, "graph", "left_semi")
    held = join_triples(stored, added, "left_semi")
    fresh = join_triples(added, held, "left_anti").sortWithinPartitions("graph", "p", "s")
    fresh.write.mode("append").partitionBy("graph").parquet(path)
