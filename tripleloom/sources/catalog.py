"""What the session's catalog holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CATALOG_TABLE_SCHEMA


def current_namespace(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT current_catalog() AS catalog, current_database() AS schema")


def list_catalogs(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW CATALOGS")


def list_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW SCHEMAS")


def list_namespace(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Tables and views of a schema, the current one by default."""
    return spark.sql("SHOW TABLES" if schema is None else f"SHOW TABLES IN {schema}")


def registered_tables(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Each listed table whose name starts with ``prefix``, with its row count."""
    names = sorted(
        row.tableName for row in list_namespace(spark).collect() if row.tableName.startswith(prefix)
    )
    if not names:
        return spark.createDataFrame([], "table_name string, row_count bigint")
    counts = None
    for name in names:
        one = spark.table(f"`{name}`").agg(F.count("*").alias("row_count"))
        one = one.select(F.lit(name[len(prefix) :]).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def catalog_snapshot(spark: SparkSession, full_names: Iterable[str], catalog: str | None = None) -> DataFrame:
    """Location, comment and properties of tables as the catalog has them now.

    Absent tables have no row. Metadata only: one catalog call per table.
    ``catalog`` is looked into instead of the one a name begins with.
    """
    rows = []
    for name in full_names:
        parts = name.split(".")
        if catalog and len(parts) == 3:
            parts[0] = catalog
        quoted = ".".join(f"`{part}`" for part in parts)
        if not spark.catalog.tableExists(quoted):
            continue
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted}").collect()
        facts = {row.col_name: row.data_type for row in described}
        properties = {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {quoted}").collect()}
        rows.append(
            (
                name,
                facts.get("Type"),
                (facts.get("Provider") or "").upper(),
                facts.get("Location"),
                facts.get("Comment"),
                properties,
                None,
            )
        )
    return spark.createDataFrame(rows, CATALOG_TABLE_SCHEMA)
