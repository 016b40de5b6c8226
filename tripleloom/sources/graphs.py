"""Named graphs on storage: one partition per graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TRIPLE_SCHEMA
from ..session import remove_path, scratch_path
from ..vocab import TRIPLE_COLUMNS


def publish_graphs(
    triples: DataFrame,
    path: str,
    is_set: bool = False,
    clear_if_empty: list[str] | None = None,
) -> None:
    """Replace each graph that ``triples`` has rows for; other graphs stay as they are.

    Graphs are sets: repeated triples are stored once. ``is_set`` says that the
    input has none and spares their removal. Nothing to publish leaves the old
    graph in place; name graphs in ``clear_if_empty`` to have them emptied in
    that case.

    Rows are dealt by ranges of graph, predicate and subject and sorted by them:
    files of a graph stay few, the largest graph is still split, and their
    statistics let a scan skip row groups.
    """
    laid_out = triples.select(*TRIPLE_COLUMNS)
    if not is_set:
        laid_out = laid_out.distinct()
    laid_out = laid_out.repartitionByRange("graph", "p", "s").sortWithinPartitions("graph", "p", "s")
    (
        laid_out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("graph")
        .parquet(path)
    )
    if clear_if_empty:
        clear_graphs(triples.sparkSession, path, clear_if_empty, keep=triples)


def compact_graphs(spark: SparkSession, path: str, graphs: list[str]) -> None:
    """Write the named graphs again in the layout of :func:`publish_graphs`, after many small additions."""
    staged = scratch_path(spark, "graph-compaction")
    read_graphs(spark, path).where(F.col("graph").isin(graphs)).write.partitionBy("graph").parquet(staged)
    publish_graphs(read_graphs(spark, staged), path)
    remove_path(spark, staged)


def clear_graphs(spark: SparkSession, path: str, graphs: list[str], keep: DataFrame | None = None) -> list[str]:
    """Empty the named graphs, except those that ``keep`` has triples of."""
    kept: set[str] = set()
    if keep is not None:
        # At most as many rows as names were given.
        rows = keep.where(F.col("graph").isin(graphs)).select("graph").distinct().collect()
        kept = {row.graph for row in rows}
    gone = [name for name in graphs if name not in kept]
    for name in gone:
        remove_path(spark, f"{path}/graph={_partition_name(spark, name)}")
    return gone


def _partition_name(spark: SparkSession, graph: str) -> str:
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.escapePathName(graph)


def read_graphs(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Triples of all graphs, or of one: then only its partition is listed and read."""
    stored = spark.read.schema(TRIPLE_SCHEMA).parquet(path).select(*TRIPLE_COLUMNS)
    return stored if graph is None else stored.where(F.col("graph") == graph)
