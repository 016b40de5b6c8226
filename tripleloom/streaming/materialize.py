"""Continuous mapping execution.

A mapping works row by row, so the batch expressions run on a stream as they
are and need no state. Set semantics need state, and a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import materialize
from ..plans import MappingPlan


def read_table_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str | None = None,
    table_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A table's files as a stream.

    ``path`` is a folder, or a glob, which may also name a single file.
    """
    reader = spark.readStream.format(table_format).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_topic_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON messages of a Kafka topic; needs Spark's Kafka connector on the class path."""
    messages = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    )
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("row")).select("row.*")


def materialize_stream(rows: DataFrame, plan: MappingPlan, graph: str) -> DataFrame:
    return materialize(rows, plan, graph)


def distinct_stream(rows: DataFrame, plan: MappingPlan, graph: str, event_time: str, delay: str) -> DataFrame:
    """Triples of a stream as a set, with the event time that stated each first.

    Equal triples closer than ``delay`` collapse; the state of older ones is dropped.
    """
    stamped = rows.withColumn("_event_time", F.col(event_time).cast("timestamp")).withWatermark("_event_time", delay)
    triples = _with_time(stamped, plan, graph)
    keys = [name for name in triples.columns if name != "_event_time"]
    return triples.dropDuplicatesWithinWatermark(keys).withColumnRenamed("_event_time", "event_time")


def _with_time(rows: DataFrame, plan: MappingPlan, graph: str) -> DataFrame:
    return materialize(rows, plan, graph, carry=("_event_time",))


def run_available(stream: DataFrame, path: str, checkpoint: str, table_format: str = "parquet") -> DataFrame:
    """Process what is there, append it to a table, and return the table."""
    query = (
        stream.writeStream.format(table_format)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.format(table_format).load(path)
