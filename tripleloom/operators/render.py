"""Mapping declarations to mapping documents, a whole table of them at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    column_annotation,
    escape_literal,
    expand_curie,
    first_nonempty,
    safe_name,
    source_uri,
    storage_location,
    strip,
    xsd_datatype,
)
from ..vocab import CSV_FORMULATION, DEFAULT_CLASS, DEFAULT_CLASSIFICATION, DPA, RML, RR, XSD
from .lookup import look_up
from .validate import spec_problems

# The layout of a mapping document.
PREFIX_LINES = (
    f"@prefix dpa: <{DPA}> .\n"
    f"@prefix rr: <{RR}> .\n"
    f"@prefix rml: <{RML}> .\n"
    f"@prefix xsd: <{XSD}> .\n"
    "\n"
)
HEAD_LAYOUT = (
    "<{name}>\n"
    "    a rr:TriplesMap ;\n"
    '    dpa:unityCatalogObject "{object}" ;\n'
    '    dpa:unityCatalogStorageLocation "{location}" ;\n'
)
ANNOTATION_LAYOUT = '    dpa:unityCatalogColumn "{annotation}" ;\n'
SOURCE_LAYOUT = (
    "    rml:logicalSource [\n"
    '        rml:source "{source}" ;\n'
    f"        rml:referenceFormulation <{CSV_FORMULATION}>\n"
    "    ] ;\n"
)
SUBJECT_LAYOUT = (
    "    rr:subjectMap [\n"
    '        rr:template "{template}" ;\n'
    "        rr:class <{class}>\n"
    "    ]"
)
LITERAL_LAYOUT = (
    "    rr:predicateObjectMap [\n"
    "        rr:predicate <{predicate}> ;\n"
    "        rr:objectMap [\n"
    '            rml:reference "{reference}" ;\n'
    "            rr:datatype <{datatype}>\n"
    "        ]\n"
    "    ]"
)
REFERENCE_LAYOUT = (
    "    rr:predicateObjectMap [\n"
    "        rr:predicate <{predicate}> ;\n"
    "        rr:objectMap [\n"
    '            rr:template "{template}"\n'
    "        ]\n"
    "    ]"
)
CLASSIFICATION_LAYOUT = (
    "    rr:predicateObjectMap [\n"
    "        rr:predicate <{predicate}> ;\n"
    "        rr:object <{term}>\n"
    "    ]"
)
BETWEEN_MAPS = " ;\n"
LAST_LINE = " .\n"


def _fill(layout: str, **slots: Column) -> Column:
    """A layout with its named slots replaced by columns."""
    pieces: list[Column] = []
    rest = layout
    while rest:
        at = min((rest.find("{" + name + "}") for name in slots if "{" + name + "}" in rest), default=-1)
        if at < 0:
            pieces.append(F.lit(rest))
            break
        if at:
            pieces.append(F.lit(rest[:at]))
        name, _, rest = rest[at + 1 :].partition("}")
        pieces.append(slots[name])
    return F.concat(*pieces)


def _filled_template(template: Column, column: Column) -> Column:
    return escape_literal(F.replace(template, F.lit("{value}"), F.concat(F.lit("{"), column, F.lit("}"))))


def payload_text() -> Column:
    """A declaration row as JSON, without its id."""
    return F.to_json(F.struct("ontology", "profile", "dataset"))


def spec_key() -> Column:
    """What tells declarations apart: ids do not, as two mappings of one dataset share theirs."""
    return F.md5(payload_text())


def render_rml(specs: DataFrame, schemes: DataFrame) -> DataFrame:
    """``(mapping_id, rml)`` per different declaration; ``rml`` is null where it has errors."""
    return render_keyed(specs, schemes).select("mapping_id", "rml")


def render_keyed(specs: DataFrame, schemes: DataFrame) -> DataFrame:
    """Documents with the :func:`spec_key` of their declarations.

    Each declaration is opened into its columns, the schemes are joined once,
    and the finished texts meet again under id and key. A group is one
    declaration's columns, so it is as large as one input row; copies of a
    declaration add nothing to it and drop out on the map side.
    """
    column_type = specs.schema["dataset"].dataType["columns"].dataType
    data = F.col("dataset")
    subject = data["subject_identifier"]
    opened = specs.select(
        "mapping_id",
        spec_key().alias("spec_key"),
        (F.size(spec_problems()) == 0).alias("sound"),
        strip(F.coalesce(data["name"], F.lit(""))).alias("name"),
        strip(subject["scheme"]).alias("subject_scheme"),
        strip(subject["column"]).alias("subject_column"),
        F.coalesce(first_nonempty(data["row_subject"]["rdf_class"]), F.lit(DEFAULT_CLASS)).alias("rdf_class"),
        data["storage_location"].alias("location"),
        data["source_uri"].alias("source"),
        F.filter(
            F.coalesce(data["columns"], F.array().cast(column_type)),
            lambda column: ~column["kind"].eqNullSafe("ignore"),
        ).alias("mapped"),
    )
    located = opened.withColumn("location", storage_location(F.col("name"), F.col("location")))
    sourced = located.withColumn("source", source_uri(F.col("location"), F.col("source")))
    # Item 0 stands for the mapping itself, the others for its columns.
    head = F.struct(F.lit(0).alias("pos"), F.lit(None).cast(column_type.elementType).alias("column"))
    others = F.transform("mapped", lambda column, at: F.struct((at + 1).alias("pos"), column.alias("column")))
    items = sourced.select("*", F.inline(F.concat(F.array(head), others)).alias("pos", "column")).drop("mapped")

    is_head = F.col("pos") == 0
    column = F.col("column")
    kind = column["kind"]
    is_reference = kind.eqNullSafe("entity_reference")
    declared_type = F.coalesce(first_nonempty(column["type_name"]), F.lit("STRING"))
    given = items.select(
        "mapping_id",
        "spec_key",
        "pos",
        "sound",
        "name",
        "location",
        "source",
        kind.alias("kind"),
        (is_head | is_reference).alias("needs_scheme"),
        F.when(is_head, F.col("subject_scheme")).when(is_reference, column["scheme"]).alias("scheme"),
        F.when(is_head, F.col("subject_column")).otherwise(F.coalesce(column["name"], F.lit(""))).alias("field"),
        column_annotation(column["name"], column["type_name"], column["comment"]).alias("annotation"),
        first_nonempty(column["predicate"]).alias("predicate"),
        # The class of a mapping, the datatype of a literal, the term of a classification.
        F.when(is_head, F.col("rdf_class"))
        .when(kind == "literal", F.coalesce(first_nonempty(column["datatype"]), xsd_datatype(declared_type)))
        .otherwise(F.coalesce(column["term"], F.lit("")))
        .alias("what"),
    )
    expanded = given.withColumns(
        {"predicate": expand_curie(F.col("predicate")), "what": expand_curie(F.col("what"))}
    )

    found = look_up(expanded, F.col("scheme"), schemes.select("scheme_id", "template"), "scheme_id")

    predicate, what, field = F.col("predicate"), F.col("what"), F.col("field")
    template = _filled_template(F.col("template"), field)
    object_map = (
        F.when(
            F.col("kind") == "literal",
            _fill(LITERAL_LAYOUT, predicate=predicate, reference=escape_literal(field), datatype=what),
        )
        .when(F.col("kind") == "entity_reference", _fill(REFERENCE_LAYOUT, predicate=predicate, template=template))
        .when(
            F.col("kind") == "classification",
            _fill(
                CLASSIFICATION_LAYOUT,
                predicate=F.coalesce(predicate, F.lit(DEFAULT_CLASSIFICATION)),
                term=what,
            ),
        )
    )
    texts = found.select(
        "mapping_id",
        "spec_key",
        "pos",
        (F.col("sound") & ~(F.col("needs_scheme") & F.col("template").isNull())).alias("sound"),
        F.when(
            is_head,
            _fill(
                PREFIX_LINES + HEAD_LAYOUT,
                name=safe_name(F.col("mapping_id")),
                object=escape_literal(F.col("name")),
                location=escape_literal(F.col("location")),
            ),
        )
        .otherwise(_fill(ANNOTATION_LAYOUT, annotation=escape_literal(F.col("annotation"))))
        .alias("top"),
        F.when(
            is_head,
            F.concat(
                _fill(SOURCE_LAYOUT, source=escape_literal(F.col("source"))),
                _fill(SUBJECT_LAYOUT, **{"template": template, "class": what}),
            ),
        )
        .otherwise(object_map)
        .alias("body"),
    )
    whole = texts.groupBy("mapping_id", "spec_key").agg(
        F.bool_and("sound").alias("sound"),
        F.array_sort(F.collect_set(F.struct("pos", "top", "body"))).alias("items"),
    )
    text = F.concat(
        F.array_join(F.transform("items", lambda item: item["top"]), ""),
        F.array_join(F.array_compact(F.transform("items", lambda item: item["body"])), BETWEEN_MAPS),
        F.lit(LAST_LINE),
    )
    return whole.select("mapping_id", "spec_key", F.when(F.col("sound"), text).alias("rml"))
