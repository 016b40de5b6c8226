"""Graph stores in buckets of subjects, for graphs that change often.

Files lie in folders by graph and, within them, in buckets by a hash of the subject. What is added or taken away is
dealt by the same hash, so each bucket meets its own changes: the stored side of an update is read where it lies and is
never shuffled, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TRIPLE_SCHEMA
from ..session import remove_path, scratch_path
from ..vocab import TRIPLE_COLUMNS

_STORED = [*[name for name in TRIPLE_COLUMNS if name != "graph"], "graph"]


@contextmanager
def _by_subject(spark: SparkSession) -> Iterator[None]:
    """Lets a join over whole triples use a partitioning by subject on both sides."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)

#: Triples in a bucket that a task sorts and compares in a few hundred MB.
TRIPLES_PER_BUCKET = 250_000


def buckets_for(triples: int, least: int = 4) -> int:
    """Buckets of a store whose largest graph has about so many triples."""
    return max(least, -(-triples // TRIPLES_PER_BUCKET))


class BucketedStore:
    """Named graphs below ``path``, each a set of triples in ``buckets`` buckets of subjects.

    The number of buckets is fixed when a store is made; give the same one when it is opened again. Choose it so that a
    bucket of the largest graph fits a task. Writers of one store must take turns.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table = "graphs_" + hashlib.sha256(f"{self.path} {buckets}".encode()).hexdigest()[:24]
        self._open()

    def _open(self) -> None:
        """Declare the store anew, with the graphs whose folders are there; dropping the declaration drops no data."""
        system, files = self._files()
        system.mkdirs(files.Path(self.path))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._declare(self.table, self.path)
        self.spark.catalog.recoverPartitions(self.table)

    def _files(self):
        context = self.spark.sparkContext
        files = context._jvm.org.apache.hadoop.fs
        return files.Path(self.path).getFileSystem(context._jsc.hadoopConfiguration()), files

    def _declare(self, table: str, path: str) -> None:
        columns = ", ".join(f"{name} {TRIPLE_SCHEMA[name].dataType.simpleString()}" for name in _STORED)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (graph) "
            f"CLUSTERED BY (s) SORTED BY (s) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self, graph: str | None = None) -> DataFrame:
        found = self.spark.table(self.table).select(*TRIPLE_COLUMNS)
        return found if graph is None else found.where(F.col("graph") == graph)

    def _dealt(self, triples: DataFrame) -> DataFrame:
        """A set of triples in the layout of the store; one shuffle serves both."""
        return triples.select(*TRIPLE_COLUMNS).repartition(self.buckets, "s").distinct()

    def fresh(self, new: DataFrame) -> DataFrame:
        """Those of ``new`` that the store does not have."""
        return self._met(self._dealt(new), self.read())

    def remaining(self, gone: DataFrame) -> DataFrame:
        """The graphs that ``gone`` names, without its triples."""
        names = gone.select("graph").distinct()
        return self._met(self.read().join(F.broadcast(names) if self._few(names) else names, "graph", "left_semi"), self._dealt(gone))

    @staticmethod
    def _few(names: DataFrame, most: int = 10_000) -> bool:
        return names.limit(most + 1).count() <= most

    @staticmethod
    def _met(left: DataFrame, right: DataFrame) -> DataFrame:
        # Nulls are equal here; the subject never is null and is what both sides lie by.
        same = [F.col("l.s") == F.col("r.s"), *[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in TRIPLE_COLUMNS if c != "s"]]
        return left.alias("l").join(right.hint("merge").alias("r"), same, "left_anti").select(*TRIPLE_COLUMNS)

    def _write(self, triples: DataFrame, table: str) -> None:
        # A batch of a stream has a session of its own, and its settings are those that count.
        with _by_subject(triples.sparkSession):
            triples.select(*_STORED).write.mode("append").insertInto(table)
        self.spark.catalog.refreshTable(table)

    def insert(self, new: DataFrame) -> None:
        """INSERT: triples the store has stay as they are, the others are added to their buckets."""
        self._write(self.fresh(new), self.table)

    def delete(self, gone: DataFrame) -> None:
        """DELETE: exact matches go. Only the graphs that ``gone`` names are written again."""
        self._replace(self.remaining(gone), gone)

    def publish(self, triples: DataFrame) -> None:
        """Replace each graph that ``triples`` has rows for by them, as sets; other graphs stay as they are."""
        self._replace(self._dealt(triples), triples)

    def _replace(self, state: DataFrame, named: DataFrame) -> None:
        """The new state is complete beside the store before the first old graph goes."""
        staged = scratch_path(self.spark, "bucketed")
        table = "staged_" + hashlib.sha256(staged.encode()).hexdigest()[:24]
        self._declare(table, staged)
        self._write(state, table)
        # One name a graph; each is one folder to replace.
        graphs = [row.graph for row in named.select("graph").distinct().toLocalIterator()]
        system, files = self._files()
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for graph in graphs:
            old, new = files.Path(f"{self.path}/graph={escaped(graph)}"), files.Path(f"{staged}/graph={escaped(graph)}")
            system.delete(old, True)
            if system.exists(new):
                system.rename(new, old)
        self.spark.sql(f"DROP TABLE {table}")
        remove_path(self.spark, staged)
        self._open()
