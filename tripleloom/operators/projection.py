"""From mapping documents to catalog tables, and what differs from the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import first_nonempty
from ..vocab import PROPERTY_SOURCE


def projection_plan(projections: DataFrame, classes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Projections with the label and comment of their class, of all mappings or of ``ids(id)``.

    A class the ontology lacks is labelled by its IRI and has no comment.
    """
    if ids is not None:
        wanted = ids.select(F.col("id").alias("mapping_id")).distinct()
        projections = projections.join(wanted, "mapping_id", "left_semi")
    known = classes.select(
        F.col("iri").alias("class_iri"), F.col("label").alias("_label"), F.col("comment").alias("_comment")
    )
    return (
        projections.join(known, "class_iri", "left")
        .withColumn("class_label", F.coalesce("_label", "class_iri"))
        .withColumn("class_comment", F.coalesce("_comment", F.lit("")))
        .drop("_label", "_comment")
    )


def namespaces(plan: DataFrame) -> DataFrame:
    """Catalogs and schemas that must exist first; a row without schema is the catalog itself."""
    parts = F.split("full_name", "\\.")
    named = plan.where(F.size(parts) == 3).select(parts.alias("parts"))
    catalog, schema = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    return named.select(
        F.stack(F.lit(2), catalog, F.lit(None).cast("string"), catalog, schema).alias("catalog_name", "schema_name")
    ).distinct()


def desired_tables(plan: DataFrame) -> DataFrame:
    """Catalog entries the plan asks for. Incomplete projections are left to the checks."""
    complete = (
        (F.coalesce("storage_location", F.lit("")) != "")
        & (F.size("columns") > 0)
        & (F.size(F.split("full_name", "\\.")) == 3)
    )
    return plan.where(complete).select(
        "full_name",
        F.lit("EXTERNAL").alias("table_type"),
        F.lit("DELTA").alias("data_source_format"),
        "storage_location",
        first_nonempty(F.col("class_comment"), F.col("class_label"), F.col("class_iri")).alias("comment"),
        F.create_map(
            F.lit("semantic.class"),
            F.col("class_iri"),
            F.lit("semantic.label"),
            F.col("class_label"),
            F.lit("semantic.source"),
            F.lit(PROPERTY_SOURCE),
        ).alias("properties"),
        "columns",
    )


def first_of_each_name(desired: DataFrame) -> DataFrame:
    """One entry for each table name: that of the first place and class in their order."""
    whole = F.struct(*[F.col(name) for name in desired.columns if name != "properties"], F.to_json("properties").alias("_facts"))
    key = F.struct("storage_location", F.col("properties")["semantic.class"])
    firsts = desired.groupBy("full_name").agg(F.min_by(whole, key).alias("first"))
    parsed = F.from_json("first._facts", "map<string,string>").alias("properties")
    return firsts.select(*[parsed if name == "properties" else F.col("first")[name].alias(name) for name in desired.columns])


def name_conflicts(desired: DataFrame) -> DataFrame:
    """Properties in which projections of one table name differ from the first of them, as drift rows."""
    firsts = first_of_each_name(desired)
    return property_drift(desired, firsts).distinct()


def create_actions(desired: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries the catalog lacks. Those it has are only checked, never changed."""
    return desired.join(catalog.select("full_name"), "full_name", "left_anti")


def property_drift(desired: DataFrame, catalog: DataFrame, strict: bool = True) -> DataFrame:
    """Expected properties that an existing entry lacks or has otherwise."""
    present = catalog.select("full_name", F.col("properties").alias("_present"))
    compared = desired.select("full_name", F.col("properties").alias("_wanted")).join(present, "full_name")
    return (
        compared.select("full_name", "_present", F.explode("_wanted").alias("property", "expected"))
        .select(
            "full_name",
            "property",
            "expected",
            F.try_element_at("_present", F.col("property")).alias("actual"),
            F.lit("error" if strict else "warning").alias("severity"),
        )
        .where(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def semantic_check(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries whose class property or location is not what ``expected(full_name, class_iri,
    storage_location)`` says; an entry the catalog lacks counts as well.
    """
    present = catalog.select(
        "full_name",
        F.try_element_at("properties", F.lit("semantic.class")).alias("actual_class"),
        F.col("storage_location").alias("actual_location"),
    )
    joined = expected.select("full_name", "class_iri", "storage_location").join(present, "full_name", "left")
    wrong_class = ~F.col("class_iri").eqNullSafe(F.col("actual_class"))
    wrong_location = ~F.col("storage_location").eqNullSafe(F.col("actual_location"))
    return joined.select(
        "full_name",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        wrong_class,
                        F.struct(
                            F.lit("semantic.class").alias("fact"),
                            F.col("class_iri").alias("expected"),
                            F.col("actual_class").alias("actual"),
                        ),
                    ),
                    F.when(
                        wrong_location,
                        F.struct(
                            F.lit("storage_location").alias("fact"),
                            F.col("storage_location").alias("expected"),
                            F.col("actual_location").alias("actual"),
                        ),
                    ),
                )
            )
        ),
    )


def raise_on_drift(drift: DataFrame) -> None:
    first = drift.where(F.col("severity") == "error").orderBy("full_name", "property").limit(1).collect()
    if first:
        row = first[0]
        raise RuntimeError(
            f"{row.full_name} exists with {row.property} = {row.actual!r}, expected {row.expected!r}"
        )


def _name(*parts: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply_projection(
    spark: SparkSession,
    actions: DataFrame,
    table_format: str = "delta",
    catalog: str | None = None,
    location: str | None = None,
) -> list[str]:
    """Create the tables in Spark's catalog, after their schemas, and return their names.

    This is catalog metadata: one statement per table, streamed to the driver
    row by row. ``catalog`` puts all tables into one catalog under their schema
    and table name; ``location`` puts their data below one folder.
    """
    made: list[str] = []
    seen: set[tuple[str, str]] = set()
    for row in actions.toLocalIterator():
        catalog_name, schema, table = row.full_name.split(".")
        home = catalog or catalog_name
        if (home, schema) not in seen:
            seen.add((home, schema))
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_name(home, schema)}")
        columns = ", ".join(
            f"{_name(column.name)} {column.type_text} COMMENT {_text(column.comment)}" for column in row.columns
        )
        properties = ", ".join(f"{_text(key)} = {_text(value)}" for key, value in sorted(row.properties.items()))
        target = f"{location}/{schema}/{table}" if location else row.storage_location
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(home, schema, table)} ({columns}) USING {table_format} "
            f"LOCATION {_text(target)} COMMENT {_text(row.comment)} TBLPROPERTIES ({properties})"
        )
        made.append(f"{home}.{schema}.{table}")
    return made
