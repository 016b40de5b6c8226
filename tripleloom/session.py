"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution is what re-plans joins from measured sizes: it broadcasts a
# side only after seeing how large it is and splits hot keys of the others.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Recording the Python call site of every column costs more than the call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tripleloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's settings; keyword arguments use ``_`` for ``.`` in names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**ENGINE_CONF, **{key.replace("_", "."): str(value) for key, value in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions_for(shuffled_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Partitions that keep each shuffle block near ``target_bytes``, at least one per core.

    Set it as ``spark.sql.shuffle.partitions`` before a large job; adaptive
    execution merges what turns out to be too small.
    """
    return max(cores, -(-shuffled_bytes // target_bytes))


def spread(frame: DataFrame, *by: str) -> DataFrame:
    """The rows dealt anew to as many tasks as a shuffle has, evenly or by the hash of columns.

    For small files whose rows cost or make much: a file is read in as few tasks as its bytes need, and a Parquet row
    group in one.
    """
    spark = frame.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return frame.repartition(tasks, *by)


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tripleloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that no other job uses."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the scratch folder: computed once, read again, safe from lost executors."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours on whatever file system it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
