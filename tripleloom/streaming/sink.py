"""Streams into stored graphs, batch by batch, with a side table of late rows.

A batch may run again after a failure, or a whole stream may be replayed. Both give the same graph: what a batch writes
depends on its rows and on the batches before it only, late rows and time marks are kept by batch id and replaced, and
triples are added to a set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import materialize
from ..plans import MappingPlan
from ..session import spread
from ..sources.buckets import BucketedStore


class GraphSink:
    """Writes a mapped stream into a graph of a store; an instance is what ``foreachBatch`` takes.

    A row is late if its event time is more than ``delay`` (as in ``"2 days"``) before the latest event time of all
    earlier batches. Late rows go to a table below ``path`` instead of into the graph, whole, with the batch that brought
    them and the time they missed. Rows without event time are never late.
    """

    def __init__(self, store: BucketedStore, plan: MappingPlan, graph: str, event_time: str, delay: str, path: str):
        self.store, self.plan, self.graph = store, plan, graph
        self.event_time, self.delay = event_time, delay
        self.late_path, self.marks_path = f"{path.rstrip('/')}/late", f"{path.rstrip('/')}/marks"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamp = F.col(self.event_time).cast("timestamp")
        # Set here and not read from the data: the mark of a batch has to be there for the next one, even if it is null.
        mark = batch.agg(F.max(stamp).alias("latest")).select(F.lit(batch_id).cast("long").alias("batch_id"), "latest")
        self._replace(mark.coalesce(1), self.marks_path, batch_id)
        limit = self._marks(spark).where(F.col("batch_id") < batch_id).agg((F.max("latest") - F.expr(f"INTERVAL {self.delay}")).alias("limit")).first().limit
        late = F.lit(False) if limit is None else F.coalesce(stamp < F.lit(limit), F.lit(False))
        kept = batch.where(late).withColumns({"missed": F.lit(limit).cast("timestamp"), "batch_id": F.lit(batch_id).cast("long")})
        self._replace(kept, self.late_path, batch_id)
        # A batch may be one file, and a row makes several triples.
        self.store.insert(materialize(spread(batch.where(~late)), self.plan, self.graph))

    @staticmethod
    def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
        rows.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    def _marks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("batch_id long, latest timestamp").parquet(self.marks_path)

    def late(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Late rows so far, with ``missed`` and ``batch_id``; ``schema`` is that of the stream's rows."""
        fields = [*schema.fields, T.StructField("missed", T.TimestampType()), T.StructField("batch_id", T.LongType())]
        return spark.read.schema(T.StructType(fields)).parquet(self.late_path)


def run_into_graph(rows: DataFrame, sink: GraphSink, checkpoint: str) -> None:
    """Process what is there, one batch after the other, into the sink's graph."""
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
