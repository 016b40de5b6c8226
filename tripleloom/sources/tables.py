"""Tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in exactly the declared schema; a value that does not fit raises."""
    return df.to(schema)


def typed_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_table(df: DataFrame, uri: str, table_format: str = "parquet") -> None:
    """Replace the table at ``uri``. ``delta`` works where its connector is installed."""
    df.write.format(table_format).mode("overwrite").save(uri)


def read_table(spark: SparkSession, uri: str, table_format: str = "parquet") -> DataFrame:
    return spark.read.format(table_format).load(uri)


def read_back_report(written: DataFrame, read: DataFrame) -> DataFrame:
    """One row: rows on both sides, and rows that either side lacks (as bags)."""
    signed = written.withColumn("_side", F.lit(1)).unionByName(read.withColumn("_side", F.lit(-1)))
    per_row = signed.groupBy(*written.columns).agg(
        F.count_if(F.col("_side") == 1).alias("written"), F.count_if(F.col("_side") == -1).alias("read")
    )
    return per_row.groupBy().agg(
        F.coalesce(F.sum("written"), F.lit(0)).alias("written_rows"),
        F.coalesce(F.sum("read"), F.lit(0)).alias("read_rows"),
        F.coalesce(F.sum(F.greatest(F.col("written") - F.col("read"), F.lit(0))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(F.col("read") - F.col("written"), F.lit(0))), F.lit(0)).alias("extra_rows"),
    )
