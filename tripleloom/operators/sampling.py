"""The sampling job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def monte_carlo_pi(samples: DataFrame, x: Column, y: Column) -> DataFrame:
    """``(sample_count, inside_count, pi)`` from points of the unit square."""
    inside = F.count_if(x * x + y * y <= 1.0)
    return samples.agg(F.count("*").alias("sample_count"), inside.alias("inside_count")).withColumn(
        "pi", 4.0 * F.col("inside_count") / F.col("sample_count")
    )


def point_from_hash(*key: Column) -> tuple[Column, Column]:
    """A point of the unit square that depends on the key alone, so a task run again gives it again."""
    digest = F.md5(F.concat_ws(":", *key))

    def unit(first: int) -> Column:
        return F.conv(F.substring(digest, first, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    return unit(1), unit(9)


def spark_pi(spark: SparkSession, samples: int, partitions: int, seed: int = 0) -> DataFrame:
    numbers = spark.range(0, samples, 1, partitions)
    return monte_carlo_pi(numbers, *point_from_hash(F.lit(seed).cast("string"), F.col("id").cast("string")))
