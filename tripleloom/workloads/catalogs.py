"""Projection into a catalog. The catalog's present state is made from the part table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import type_json
from ..operators.projection import (
    apply_projection,
    create_actions,
    desired_tables,
    namespaces,
    projection_plan,
    property_drift,
    semantic_check,
)
from ..operators.turtle import mapping_projections
from ..session import scratch_path
from ..sources import catalog_snapshot
from ..vocab import DPA, PROPERTY_SOURCE
from . import documents
from .data import Query, case, table


def plan(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    projections = mapping_projections(documents.stored_corpus(spark, sf_dir))
    return projection_plan(projections, documents.known_classes(spark, sf_dir), ids)


_PLAN_COLUMNS = ("mapping_id", "full_name", "class_iri", "storage_location", "class_label", "class_comment")
_KNOWN = f"('{DPA}SMALL', '{DPA}PROMO', '{DPA}ECONOMY')"
_PLAN = f"""
WITH f AS ({documents._F}),
plan AS (
  SELECT k, p_brand, mapping_id, name AS full_name, class_iri, location AS storage_location,
    CASE WHEN class_iri IN {_KNOWN} THEN p_type ELSE class_iri END AS class_label,
    CASE WHEN class_iri = '{DPA}SMALL' THEN 'Small parts' ELSE '' END AS class_comment
  FROM f),
present AS (
  SELECT full_name, CASE WHEN k % 5 = 0 THEN 'dpa:Wrong' ELSE class_iri END AS class_property,
    CASE WHEN k % 7 = 0 THEN NULL ELSE class_label END AS label_property,
    CASE WHEN k % 10 = 1 THEN 's3://moved/' || k ELSE storage_location END AS present_location
  FROM plan WHERE k % 3 <> 0)
"""


def ids_of_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_brand") == "Brand#7")
        .select(
            F.concat(
                F.lit("mapping-unity-"), F.lower("p_type"), F.lit("-part."), F.col("p_partkey").cast("string")
            ).alias("id")
        )
    )


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the tables exist; some have other properties or another place."""
    key = F.col("p_partkey")
    name = F.concat(F.lower("p_type"), F.lit("/part_"), key.cast("string"))
    class_iri = case("p_partkey", {0: F.lit(DPA + "Dataset")}, F.concat(F.lit(DPA), F.col("p_type")), 4)
    label = F.when((key % 4 != 0) & F.col("p_type").isin("SMALL", "PROMO", "ECONOMY"), F.col("p_type")).otherwise(class_iri)
    location = case(
        "p_partkey", {1: F.concat(F.lit("s3://held/"), key.cast("string"))}, F.concat(F.lit("s3://unity/"), name), 4
    )
    properties = F.map_concat(
        F.create_map(
            F.lit("semantic.class"), case("p_partkey", {0: F.lit("dpa:Wrong")}, class_iri, 5), F.lit("other"), F.lit("x")
        ),
        F.create_map(F.lit("semantic.source"), F.lit(PROPERTY_SOURCE)),
        F.when(key % 7 != 0, F.create_map(F.lit("semantic.label"), label)).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    )
    return table(spark, sf_dir, "part").where(key % 3 != 0).select(
        F.concat(F.lit("unity."), F.replace(name, F.lit("/"), F.lit("."))).alias("full_name"),
        F.lit("EXTERNAL").alias("table_type"),
        F.lit("DELTA").alias("data_source_format"),
        case("p_partkey", {1: F.concat(F.lit("s3://moved/"), key.cast("string"))}, location, 10).alias("storage_location"),
        properties.alias("properties"),
    )


def desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desired_tables(plan(spark, sf_dir))


def _flat(tables: DataFrame) -> DataFrame:
    return tables.select(
        "full_name",
        "table_type",
        "data_source_format",
        "storage_location",
        "comment",
        *[F.col("properties")[f"semantic.{name}"].alias(f"semantic_{name}") for name in ("class", "label", "source")],
        F.size("columns").alias("column_count"),
    )


_DESIRED = (
    "SELECT full_name, 'EXTERNAL' AS table_type, 'DELTA' AS data_source_format, storage_location, "
    "COALESCE(NULLIF(class_comment, ''), class_label) AS comment, class_iri AS semantic_class, class_label AS semantic_label, "
    f"'{PROPERTY_SOURCE}' AS semantic_source, 5 AS column_count FROM plan"
)


def namespaces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespaces(plan(spark, sf_dir))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(create_actions(desired(spark, sf_dir), present(spark, sf_dir)))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return property_drift(desired(spark, sf_dir), present(spark, sf_dir))


def check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_check(plan(spark, sf_dir), present(spark, sf_dir))


def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table per part type, described by what the parts say, and read back."""
    schema = f"loom_{uuid.uuid4().hex[:12]}"
    wanted = (
        table(spark, sf_dir, "part")
        .groupBy("p_type")
        .agg(F.count("*").alias("n"), F.max("p_name").alias("name"))
        .select(
            F.concat(F.lit(f"unity.{schema}."), F.lower("p_type")).alias("full_name"),
            F.lit("").alias("storage_location"),
            F.concat(F.col("n").cast("string"), F.lit(" parts, it's \""), F.col("name"), F.lit('"')).alias("comment"),
            F.create_map(F.lit("semantic.class"), F.concat(F.lit(DPA), F.col("p_type"))).alias("properties"),
            F.array(
                F.struct(
                    F.lit("id").alias("name"),
                    F.lit("LONG").alias("type_text"),
                    type_json(F.lit("id"), F.lit("long")).alias("type_json"),
                    F.lit("LONG").alias("type_name"),
                    F.lit(0).alias("position"),
                    F.lit(True).alias("nullable"),
                    F.col("name").alias("comment"),
                )
            ).alias("columns"),
        )
    )
    names = apply_projection(
        spark, wanted, table_format="parquet", catalog="spark_catalog", location=scratch_path(spark, "tables")
    )
    try:
        found = catalog_snapshot(spark, names).select(
            F.substring_index("full_name", ".", -1).alias("table_name"),
            "table_type",
            "data_source_format",
            "comment",
            F.col("properties")["semantic.class"].alias("semantic_class"),
        )
    finally:
        spark.sql(f"DROP SCHEMA IF EXISTS spark_catalog.{schema} CASCADE")
    return found


_PROPERTIES = f"""
expected AS (
  SELECT full_name, 'semantic.class' AS property, class_iri AS expected FROM plan
  UNION ALL SELECT full_name, 'semantic.label', class_label FROM plan
  UNION ALL SELECT full_name, 'semantic.source', '{PROPERTY_SOURCE}' FROM plan),
actual AS (
  SELECT full_name, 'semantic.class' AS property, class_property AS actual FROM present
  UNION ALL SELECT full_name, 'semantic.label', label_property FROM present
  UNION ALL SELECT full_name, 'semantic.source', '{PROPERTY_SOURCE}' FROM present)
"""

QUERIES = {
    "projection_plan": Query(
        lambda spark, sf: plan(spark, sf).select(*_PLAN_COLUMNS), f"{_PLAN} SELECT {', '.join(_PLAN_COLUMNS)} FROM plan"
    ),
    "projection_plan_for_ids": Query(
        lambda spark, sf: plan(spark, sf, ids_of_brand(spark, sf)).select(*_PLAN_COLUMNS),
        f"{_PLAN} SELECT {', '.join(_PLAN_COLUMNS)} FROM plan WHERE p_brand = 'Brand#7'",
    ),
    "namespaces": Query(
        namespaces_query,
        f"{_PLAN} SELECT DISTINCT split_part(full_name, '.', 1) AS catalog_name, CAST(NULL AS VARCHAR) AS schema_name FROM plan "
        "UNION ALL SELECT DISTINCT split_part(full_name, '.', 1), split_part(full_name, '.', 2) FROM plan",
    ),
    "desired_tables": Query(lambda spark, sf: _flat(desired(spark, sf)), f"{_PLAN} {_DESIRED}"),
    "create_actions": Query(actions, f"{_PLAN} {_DESIRED} WHERE k % 3 = 0"),
    "property_drift": Query(
        drift,
        f"{_PLAN}, {_PROPERTIES} SELECT full_name, property, expected, actual, 'error' AS severity "
        "FROM expected JOIN actual USING (full_name, property) WHERE expected IS DISTINCT FROM actual",
    ),
    "semantic_check": Query(
        check,
        f"{_PLAN} SELECT full_name, 'semantic.class' AS fact, class_iri AS expected, class_property AS actual "
        "FROM plan LEFT JOIN present USING (full_name) WHERE class_iri IS DISTINCT FROM class_property "
        "UNION ALL SELECT full_name, 'storage_location', storage_location, present_location "
        "FROM plan LEFT JOIN present USING (full_name) WHERE storage_location IS DISTINCT FROM present_location",
    ),
    "apply_projection": Query(
        apply,
        "SELECT lower(p_type) AS table_name, 'EXTERNAL' AS table_type, 'PARQUET' AS data_source_format, "
        "count(*) || ' parts, it''s \"' || max(p_name) || '\"' AS comment, "
        f"'{DPA}' || p_type AS semantic_class FROM part GROUP BY p_type",
    ),
}
