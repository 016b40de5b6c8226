"""Checks of declarations, mapping documents, projections and instance data.

A failed check is a row ``(mapping_id, severity, rule, detail)``.
:func:`raise_on_error` gives the fail-fast behaviour of a service call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import first_nonempty, strip
from ..session import stored
from ..vocab import ONTOLOGY_ID, PROFILES, RDF_TYPE
from .lookup import look_up
from .turtle import bad_columns, expand_terms, projection_candidates, ttl_prefixes

VALIDATION_COLUMNS = ("mapping_id", "severity", "rule", "detail")


def _problem(failed: Column, rule: str, detail: Column) -> Column:
    found = F.struct(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail"))
    return F.when(failed, found)


def _blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def spec_problems() -> Column:
    """Array of the problems a declaration row shows without a look at any other table."""
    data = F.col("dataset")
    identifier = data["subject_identifier"]
    ontology = F.coalesce(first_nonempty(F.col("ontology")), F.lit(ONTOLOGY_ID))
    profile = F.coalesce(first_nonempty(F.col("profile")), F.lit(PROFILES[0]))
    whole = F.array(
        _problem(ontology != ONTOLOGY_ID, "ontology", F.concat(F.lit("Unknown ontology: "), ontology)),
        _problem(~profile.isin(*PROFILES), "profile", F.concat(F.lit("Unsupported profile: "), profile)),
        _problem(_blank(data["name"]), "dataset_name", F.lit("dataset.name is required")),
        _problem(
            _blank(identifier["column"]) | _blank(identifier["scheme"]),
            "subject_identifier",
            F.lit("dataset.subject_identifier requires column and scheme"),
        ),
    )
    per_column = F.transform(
        data["columns"],
        lambda column: _problem(
            column["kind"].isin("literal", "entity_reference")
            & (F.coalesce(column["predicate"], F.lit("")) == ""),
            "predicate",
            F.concat(
                F.lit("Column "),
                F.coalesce(column["name"], F.lit("")),
                F.lit(" "),
                F.replace(column["kind"], F.lit("_"), F.lit(" ")),
                F.lit(" mapping requires predicate"),
            ),
        ),
    )
    none = F.array().cast("array<struct<severity:string,rule:string,detail:string>>")
    return F.array_compact(F.concat(whole, F.coalesce(per_column, none)))


def validate_specs(specs: DataFrame) -> DataFrame:
    """Problems of declarations, each found in its own row."""
    return specs.select("mapping_id", F.inline(spec_problems())).select(*VALIDATION_COLUMNS)


def validate_documents(documents: DataFrame) -> DataFrame:
    """Expert documents must hold some text."""
    return documents.where(_blank(F.col("rml"))).select(
        "mapping_id",
        F.lit("error").alias("severity"),
        F.lit("ttl").alias("rule"),
        F.lit("ttl is required").alias("detail"),
    )


def unknown_schemes(specs: DataFrame, schemes: DataFrame) -> DataFrame:
    """Schemes that a subject or an entity reference names and the registry lacks."""
    data = F.col("dataset")
    subject = strip(data["subject_identifier"]["scheme"])
    references = F.transform(
        F.filter(data["columns"], lambda column: column["kind"] == "entity_reference"),
        lambda column: F.coalesce(column["scheme"], F.lit("")),
    )
    named = specs.select(
        "mapping_id",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.filter(F.array(subject), lambda scheme: scheme.isNotNull() & (scheme != "")),
                    F.coalesce(references, F.array().cast("array<string>")),
                )
            )
        ).alias("scheme"),
    )
    known = schemes.select("scheme_id")
    return named.join(known, named["scheme"] == known["scheme_id"], "left_anti").select(
        "mapping_id",
        F.lit("error").alias("severity"),
        F.lit("scheme").alias("rule"),
        F.concat(F.lit("Unknown identifier scheme: "), F.col("scheme")).alias("detail"),
    )


def unknown_classes(projections: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of projections that the ontology lacks: a warning, the mapping stays valid."""
    known = classes.select("iri")
    return projections.join(known, projections["class_iri"] == known["iri"], "left_anti").select(
        "mapping_id",
        F.lit("warning").alias("severity"),
        F.lit("class").alias("rule"),
        F.concat(F.lit("Class not found in ontology: "), F.col("class_iri")).alias("detail"),
    )


def validate_mappings(specs: DataFrame, schemes: DataFrame) -> DataFrame:
    """All error rows of declarations."""
    return validate_specs(specs).unionByName(unknown_schemes(specs, schemes))


def validation_summary(corpus: DataFrame, classes: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """``(mapping_id, valid, projection_count, warnings)`` for every document of a corpus.

    The warnings of a document sit in its row, in statement order; they cannot
    be more than the statements of that one text.
    """
    if prefixes is None:
        prefixes = ttl_prefixes(corpus)
    flagged = projection_candidates(corpus, keep_empty=True).select(
        F.col("doc_id").alias("mapping_id"),
        "stmt_pos",
        F.col("full_name").isNotNull().alias("projects"),
        (
            F.col("full_name").isNotNull()
            & F.exists("found_columns", lambda column: column["problem"].isNotNull())
        ).alias("broken"),
        F.when(F.col("full_name").isNotNull(), F.col("class_term")).alias("class_term"),
    )
    # Parsed once; each distinct term is resolved once, and rows learn only whether an IRI is missing.
    flagged = stored(flagged, "candidates")
    used = expand_terms(flagged.where("class_term is not null").select("class_term").distinct(), "class_term", prefixes, "class_iri")
    missing = used.join(classes.select(F.col("iri").alias("class_iri")), "class_iri", "left_anti")
    judged = look_up(flagged, F.col("class_term"), missing, "class_term").withColumn(
        "warning", F.concat(F.lit("Class not found in ontology: "), F.col("class_iri"))
    )
    noted = F.when(F.col("warning").isNotNull(), F.struct("stmt_pos", "warning"))
    return judged.groupBy("mapping_id").agg(
        (~F.bool_or("broken")).alias("valid"),
        F.count_if("projects").alias("projection_count"),
        F.transform(F.array_sort(F.collect_list(noted)), lambda item: item["warning"]).alias("warnings"),
    )


def projection_errors(projections: DataFrame) -> DataFrame:
    """What keeps a projection from becoming a catalog table."""
    name = F.col("full_name")
    incomplete = (F.coalesce("storage_location", F.lit("")) == "") | (F.size("columns") == 0)
    checks = F.array(
        _problem(
            incomplete,
            "projection_parts",
            F.concat(
                F.lit("Projection for "),
                name,
                F.lit(
                    " requires dpa:unityCatalogStorageLocation and at least one dpa:unityCatalogColumn."
                ),
            ),
        ),
        _problem(
            F.size(F.split(name, "\\.")) != 3,
            "object_name",
            F.concat(F.lit("Unity Catalog object must be catalog.schema.table: "), name),
        ),
    )
    return projections.select("mapping_id", F.inline(F.array_compact(checks))).select(*VALIDATION_COLUMNS)


def shacl_min_count(
    triples: DataFrame, target_class: str, path: str, min_count: int = 1, message: str = ""
) -> DataFrame:
    """Instances of a class with fewer than ``min_count`` distinct values of a property.

    One aggregation by subject over the two kinds of triples that matter.
    """
    is_target = (F.col("p") == RDF_TYPE) & (F.col("o") == target_class) & (F.col("o_type") != "literal")
    has_value = F.col("p") == path
    if min_count == 1:
        values = F.max(F.when(has_value, 1).otherwise(0))
    else:
        node = F.struct("o", "o_type", "o_datatype", "o_lang")
        values = F.count_distinct(F.when(has_value, node))
    return (
        triples.where(is_target | has_value)
        .groupBy("s")
        .agg(F.bool_or(is_target).alias("is_target"), values.cast("bigint").alias("value_count"))
        .where(F.col("is_target") & (F.col("value_count") < min_count))
        .select(
            F.col("s").alias("focus_node"), F.lit(path).alias("path"), "value_count", F.lit(message).alias("message")
        )
    )


def raise_on_error(findings: DataFrame) -> None:
    """Raise ``ValueError`` with the first error row, if there is one."""
    first = findings.where(F.col("severity") == "error").orderBy("mapping_id", "rule", "detail").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].mapping_id}: {first[0].detail}")


__all__ = [
    "bad_columns",
    "projection_errors",
    "raise_on_error",
    "shacl_min_count",
    "spec_problems",
    "unknown_classes",
    "unknown_schemes",
    "validate_documents",
    "validate_mappings",
    "validate_specs",
    "validation_summary",
]
