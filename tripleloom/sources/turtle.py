"""Turtle files as a corpus, or as lines where files are huge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.ttl") -> DataFrame:
    """``(doc_id, doc_order, text)`` of all matching files below a folder.

    The path is both the id and the order. Spark leaves out names that start
    with ``_`` or ``.``; a folder whose name starts with ``..`` is left out too.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("doc_id"),
            F.col("_metadata.file_path").alias("doc_order"),
            F.col("value").alias("text"),
        )
        .where(~F.col("doc_id").contains("/.."))
    )


def read_corpus_lines(spark: SparkSession, path: str, pattern: str = "*.ttl") -> DataFrame:
    """``(doc_id, part, line, text)`` of all matching files, cut by byte ranges as Spark cuts any text file.

    ``part`` is where a range begins in its file; ``line`` grows along the range but is not counted from one.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("doc_id"),
            F.col("_metadata.file_block_start").alias("part"),
            F.monotonically_increasing_id().alias("line"),
            F.col("value").alias("text"),
        )
        .where(~F.col("doc_id").contains("/.."))
    )
