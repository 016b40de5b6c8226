"""The registry of identifier schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REGISTRY = "schemes array<struct<id:string,label:string,template:string>>"


def _last_of_each(entries: DataFrame) -> DataFrame:
    """Entries are ``(doc_order, pos, scheme)``; the last one of an id counts."""
    return (
        entries.groupBy(F.col("scheme.id").alias("scheme_id"))
        .agg(F.max_by("scheme", F.struct("doc_order", "pos")).alias("scheme"))
        .select(
            "scheme_id",
            F.coalesce("scheme.label", "scheme_id").alias("label"),
            F.col("scheme.template").alias("template"),
        )
    )


def parse_schemes(documents: DataFrame) -> DataFrame:
    """``(scheme_id, label, template)`` out of registry documents ``(doc_order, json)``."""
    parsed = documents.select("doc_order", F.from_json("json", _REGISTRY).alias("registry"))
    return _last_of_each(parsed.select("doc_order", F.posexplode("registry.schemes").alias("pos", "scheme")))


def read_schemes(spark: SparkSession, path: str) -> DataFrame:
    """Registry files, each one JSON document."""
    files = spark.read.schema(_REGISTRY).json(path, multiLine=True)
    return _last_of_each(
        files.select(
            F.col("_metadata.file_path").alias("doc_order"), F.posexplode("schemes").alias("pos", "scheme")
        )
    )


def scheme_by_id(schemes: DataFrame, scheme_id: str) -> DataFrame:
    """The one scheme of that id. Raises ``ValueError`` if there is none."""
    found = schemes.where(F.col("scheme_id") == scheme_id)
    if found.isEmpty():
        raise ValueError(f"Unknown identifier scheme: {scheme_id}")
    return found


def scheme_templates(schemes: DataFrame, wanted: list[str]) -> dict[str, str]:
    """Templates of the named schemes, for planning a mapping on the driver."""
    rows = schemes.where(F.col("scheme_id").isin(wanted)).select("scheme_id", "template").collect()
    return {row.scheme_id: row.template for row in rows}
