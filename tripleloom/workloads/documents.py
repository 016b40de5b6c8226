"""Corpora of mapping and ontology documents, all derived from the part table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SPEC_SCHEMA
from ..operators.render import render_rml
from ..operators.rml_rules import document_triples, rejected_documents
from ..operators.turtle import (
    bad_columns,
    catalog_columns,
    corpus_of,
    mapping_projections,
    ontology_classes,
    ontology_summary,
    term_lookup,
    ttl_prefixes,
    ttl_statements,
)
from ..operators.validate import (
    projection_errors,
    shacl_min_count,
    unknown_classes,
    unknown_schemes,
    validate_documents,
    validate_specs,
    validation_summary,
)
from ..session import spread, stored
from ..vocab import CSV_FORMULATION, DPA, OWL_CLASS, RDF_TYPE, RDFS_COMMENT, RML, RR, XSD
from .data import Query, case, table

# The schemes the declarations below refer to.
SCHEME_ROWS = [
    ("shop:article", "Article number", "https://parts.example/article/{value}"),
    ("shop:bin", "Place in the store", "https://parts.example/store/bin/{value}"),
    ("shop:brand", "Brand", "https://parts.example/brand/{value}"),
]


def schemes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEME_ROWS, "scheme_id string, label string, template string")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts in all tasks: a part is a few bytes in the file, and a whole document to write and to read."""
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _rule(**given: Column | str) -> Column:
    fields = SPEC_SCHEMA["dataset"].dataType["columns"].dataType.elementType.fieldNames()
    cells = []
    for name in fields:
        value = given.get(name)
        cell = F.lit(value).cast("string") if value is None or isinstance(value, str) else value
        cells.append(cell.alias(name))
    return F.struct(*cells)


def specs(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """One declaration per part. With ``broken``, some of every kind of mistake."""
    key = _text("p_partkey")
    name = F.concat(F.lit("unity."), F.lower("p_type"), F.lit(".part_"), key)
    scheme = case("p_partkey", {0: F.lit("shop:article"), 1: F.lit(" shop:bin ")}, F.lit("shop:brand"), 3)
    id_column, name_predicate, brand_scheme = F.lit("p_partkey"), F.lit("dpa:name"), F.lit("shop:brand")
    ontology, profile = F.lit("manufacturing-rdl"), F.lit("spark-delta")
    if broken:
        name = case("p_partkey", {0: F.lit("  ")}, name, 11)
        scheme = case("p_partkey", {0: F.lit("nope:x")}, scheme, 7)
        id_column = case("p_partkey", {0: F.lit("")}, id_column, 13)
        name_predicate = case("p_partkey", {0: F.lit("")}, name_predicate, 17)
        brand_scheme = case("p_partkey", {0: F.lit("nope:y")}, brand_scheme, 29)
        ontology = case("p_partkey", {0: F.lit("other"), 1: F.lit("")}, ontology, 19)
        profile = case("p_partkey", {0: F.lit("pandas"), 1: F.lit(None).cast("string")}, profile, 23)
    columns = F.array(
        _rule(
            name="p_partkey",
            type_name="long",
            comment=F.concat(F.lit('Key "id" of '), F.col("p_name")),
            kind="literal",
            predicate="dpa:partKey",
            datatype="",
        ),
        _rule(name="p_name", type_name="STRING", comment="", kind="literal", predicate=name_predicate),
        _rule(
            name="p_brand",
            type_name="",
            comment="Brand: \\ maker",
            kind="entity_reference",
            predicate="mfg:brand",
            scheme=brand_scheme,
        ),
        _rule(name="p_type", type_name="STRING", kind="classification", term=F.concat(F.lit("dpa:"), F.col("p_type"))),
        _rule(name="p_size", type_name="INT", comment="internal", kind="ignore"),
        _rule(
            name="p_retailprice",
            type_name="DOUBLE",
            kind="literal",
            predicate="https://example.org/price",
            datatype="xsd:decimal",
        ),
    )
    return parts(spark, sf_dir).select(
        F.concat(F.lit("mapping-unity-"), F.lower("p_type"), F.lit("-part."), key).alias("mapping_id"),
        ontology.alias("ontology"),
        profile.alias("profile"),
        F.struct(
            name.alias("name"),
            F.struct(
                case("p_partkey", {0: F.lit("")}, F.concat(F.lit("dpa:"), F.col("p_type")), 4).alias("rdf_class"),
                F.col("p_name").alias("label"),
            ).alias("row_subject"),
            F.struct(id_column.alias("column"), scheme.alias("scheme")).alias("subject_identifier"),
            case("p_partkey", {0: F.concat(F.lit("s3a://parts/"), key)}, F.lit(""), 4).alias("source_uri"),
            case("p_partkey", {1: F.concat(F.lit("s3://held/"), key)}, F.lit(None).cast("string"), 4).alias(
                "storage_location"
            ),
            columns.alias("columns"),
        ).alias("dataset"),
    )


# Facts of the declarations above, as SQL over part.
_F = f"""
SELECT p_partkey AS k, p_type, p_name, p_brand, 'mapping-unity-' || lower(p_type) || '-part.' || p_partkey AS mapping_id,
  'unity.' || lower(p_type) || '.part_' || p_partkey AS name,
  '{DPA}' || CASE WHEN p_partkey % 4 = 0 THEN 'Dataset' ELSE p_type END AS class_iri,
  CASE p_partkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'store/bin' ELSE 'brand' END AS scheme_path,
  CASE WHEN p_partkey % 4 = 1 THEN 's3://held/' || p_partkey ELSE 's3://unity/' || lower(p_type) || '/part_' || p_partkey END AS location
FROM part
"""

_RENDER_SQL = f"""
WITH f AS ({_F})
SELECT mapping_id, concat_ws(chr(10),
  '@prefix dpa: <{DPA}> .', '@prefix rr: <{RR}> .', '@prefix rml: <{RML}> .', '@prefix xsd: <{XSD}> .', '',
  '<' || replace(mapping_id, '.', '-') || '>',
  '    a rr:TriplesMap ;',
  '    dpa:unityCatalogObject "' || name || '" ;',
  '    dpa:unityCatalogStorageLocation "' || location || '" ;',
  '    dpa:unityCatalogColumn "p_partkey:LONG:Key \\"id\\" of ' || p_name || '" ;',
  '    dpa:unityCatalogColumn "p_name:STRING" ;',
  '    dpa:unityCatalogColumn "p_brand:STRING:Brand: \\\\ maker" ;',
  '    dpa:unityCatalogColumn "p_type:STRING" ;',
  '    dpa:unityCatalogColumn "p_retailprice:DOUBLE" ;',
  '    rml:logicalSource [',
  '        rml:source "' || CASE WHEN k % 4 = 0 THEN 's3a://parts/' || k ELSE 's3a' || substr(location, 3) END || '" ;',
  '        rml:referenceFormulation <{CSV_FORMULATION}>',
  '    ] ;',
  '    rr:subjectMap [',
  '        rr:template "https://parts.example/' || scheme_path || '/{{p_partkey}}" ;',
  '        rr:class <' || class_iri || '>',
  '    ] ;',
  '    rr:predicateObjectMap [', '        rr:predicate <{DPA}partKey> ;', '        rr:objectMap [',
  '            rml:reference "p_partkey" ;', '            rr:datatype <{XSD}long>', '        ]', '    ] ;',
  '    rr:predicateObjectMap [', '        rr:predicate <{DPA}name> ;', '        rr:objectMap [',
  '            rml:reference "p_name" ;', '            rr:datatype <{XSD}string>', '        ]', '    ] ;',
  '    rr:predicateObjectMap [', '        rr:predicate <{DPA}mfg/brand> ;', '        rr:objectMap [',
  '            rr:template "https://parts.example/brand/{{p_brand}}"', '        ]', '    ] ;',
  '    rr:predicateObjectMap [', '        rr:predicate <{DPA}classifiedAs> ;', '        rr:object <{DPA}' || p_type || '>', '    ] ;',
  '    rr:predicateObjectMap [', '        rr:predicate <https://example.org/price> ;', '        rr:objectMap [',
  '            rml:reference "p_retailprice" ;', '            rr:datatype <{XSD}decimal>', '        ]', '    ] .', '') AS rml
FROM f
"""


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_rml(specs(spark, sf_dir), schemes(spark))


def render_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which declarations give a document once mistakes are made."""
    made = render_rml(specs(spark, sf_dir, broken=True), schemes(spark))
    return made.select("mapping_id", F.col("rml").isNotNull().alias("rendered"))


_RENDER_BROKEN_SQL = """
SELECT 'mapping-unity-' || lower(p_type) || '-part.' || p_partkey AS mapping_id,
  p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 29 <> 0
  AND p_partkey % 19 <> 0 AND p_partkey % 23 <> 0 AS rendered
FROM part
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_of(render(spark, sf_dir))


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For questions that read the documents more than once: they are rendered once."""
    return stored(corpus(spark, sf_dir), "corpus")


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part declares its type as a prefix; the last part of a type decides what it means."""
    documents = parts(spark, sf_dir).select(
        F.col("p_partkey").alias("doc_id"),
        F.col("p_partkey").alias("doc_order"),
        F.concat(
            F.lit("# @prefix old: <x> .\n@prefix "),
            F.lower("p_type"),
            F.lit(":   <https://x.example/first/> .\n@prefix : <https://x.example/none/> .\n@prefix "),
            F.lower("p_type"),
            F.lit(": <https://x.example/"),
            F.col("p_partkey").cast("string"),
            F.lit("/>.\n"),
        ).alias("text"),
    )
    return ttl_prefixes(documents)


_PREFIX_SQL = """
SELECT lower(p_type) AS prefix, 'https://x.example/' || max(p_partkey) || '/' AS iri FROM part GROUP BY lower(p_type)
UNION ALL SELECT 'old', 'x'
"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttl_statements(corpus(spark, sf_dir)).select("doc_id", F.col("stmt_pos").cast("bigint"), "statement")


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ontology document per part: its type and its brand as classes, again and again."""
    documents = parts(spark, sf_dir).select(
        F.col("p_partkey").alias("doc_id"),
        F.col("p_partkey").alias("doc_order"),
        F.concat(
            F.lit(f"@prefix dpa: <{DPA}> .\n@prefix mfg: <{DPA}mfg#> .\n\n# a comment.\ndpa:"),
            F.col("p_type"),
            F.lit('\n    a owl:Class ;\n    rdfs:label "'),
            F.col("p_name"),
            F.lit('" ;\n    rdfs:comment "Part '),
            F.col("p_partkey").cast("string"),
            F.lit('" .\n\nmfg:'),
            F.regexp_replace("p_brand", "#", "-"),
            F.lit(" a <http://www.w3.org/2000/01/rdf-schema#Class> .\n\ndpa:note a owl:AnnotationProperty .\nloose end"),
        ).alias("text"),
    )
    return documents


_CLASSES = f"""
SELECT '{DPA}' || p_type AS iri, arg_max(p_name, p_partkey) AS label, 'Part ' || max(p_partkey) AS comment,
       min(p_partkey) AS first_order, 0 AS first_pos FROM part GROUP BY p_type
UNION ALL
SELECT '{DPA}mfg#' || replace(p_brand, '#', '-'), 'mfg#' || replace(p_brand, '#', '-'), '', min(p_partkey), 1 FROM part GROUP BY p_brand
"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology_classes(ontology(spark, sf_dir))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms asked for by tail, by longer tail and by IRI, and some nobody declares."""
    wanted = table(spark, sf_dir, "part").select(
        F.explode(
            F.array(
                F.col("p_type"),
                F.regexp_replace("p_brand", "#", "-"),
                F.concat(F.lit("ontology/"), F.col("p_type")),
                F.concat(F.lit(DPA), F.col("p_type")),
                F.col("p_name"),
            )
        ).alias("term")
    )
    return term_lookup(wanted, classes(spark, sf_dir))


_TERMS_SQL = f"""
WITH c AS ({_CLASSES}),
w AS (SELECT DISTINCT unnest([p_type, replace(p_brand, '#', '-'), 'ontology/' || p_type, '{DPA}' || p_type, p_name]) AS term FROM part),
m AS (SELECT term, iri, label, comment, row_number() OVER (PARTITION BY term ORDER BY first_order, first_pos) AS n
      FROM w LEFT JOIN c ON iri = term OR ends_with(iri, '/' || term) OR ends_with(iri, '#' || term))
SELECT term, iri, label, comment FROM m WHERE n = 1
"""


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_columns(corpus(spark, sf_dir))


_COLUMNS_SQL = f"""
WITH f AS ({_F}),
c AS (
  SELECT mapping_id AS doc_id, name AS full_name, 'p_partkey' AS name, 'LONG' AS t, 'long' AS j, 0 AS position, 'Key \\' AS comment FROM f
  UNION ALL SELECT mapping_id, name, 'p_name', 'STRING', 'string', 1, '' FROM f
  UNION ALL SELECT mapping_id, name, 'p_brand', 'STRING', 'string', 2, 'Brand: \\\\ maker' FROM f
  UNION ALL SELECT mapping_id, name, 'p_type', 'STRING', 'string', 3, '' FROM f
  UNION ALL SELECT mapping_id, name, 'p_retailprice', 'DOUBLE', 'double', 4, '' FROM f)
SELECT doc_id, full_name, name, t AS type_text,
  '{{"name":"' || name || '","type":"' || j || '","nullable":true,"metadata":{{}}}}' AS type_json, t AS type_name, position,
  true AS nullable, comment
FROM c
"""


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_projections(stored_corpus(spark, sf_dir)).select(
        "mapping_id",
        "full_name",
        "class_iri",
        "storage_location",
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("column_names"),
    )


_PROJECTIONS_SQL = f"""
WITH f AS ({_F})
SELECT mapping_id, name AS full_name, class_iri, location AS storage_location,
  'p_partkey,p_name,p_brand,p_type,p_retailprice' AS column_names
FROM f
"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology_summary(classes(spark, sf_dir), schemes(spark))


# -- validation -----------------------------------------------------------------------------------


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mistakes of declarations, and expert documents of which some are blank."""
    documents = parts(spark, sf_dir).select(
        F.concat(F.lit("doc-"), _text("p_partkey")).alias("mapping_id"),
        case("p_partkey", {0: F.lit(" \t\n"), 1: F.lit(None).cast("string")}, F.col("p_name"), 31).alias("rml"),
    )
    return validate_specs(specs(spark, sf_dir, broken=True)).unionByName(validate_documents(documents))


_ID = "'mapping-unity-' || lower(p_type) || '-part.' || p_partkey"
_VALIDATE_SQL = f"""
SELECT {_ID} AS mapping_id, 'error' AS severity, 'ontology' AS rule, 'Unknown ontology: other' AS detail FROM part WHERE p_partkey % 19 = 0
UNION ALL SELECT {_ID}, 'error', 'profile', 'Unsupported profile: pandas' FROM part WHERE p_partkey % 23 = 0
UNION ALL SELECT {_ID}, 'error', 'dataset_name', 'dataset.name is required' FROM part WHERE p_partkey % 11 = 0
UNION ALL SELECT {_ID}, 'error', 'subject_identifier', 'dataset.subject_identifier requires column and scheme' FROM part WHERE p_partkey % 13 = 0
UNION ALL SELECT {_ID}, 'error', 'predicate', 'Column p_name literal mapping requires predicate' FROM part WHERE p_partkey % 17 = 0
UNION ALL SELECT 'doc-' || p_partkey, 'error', 'ttl', 'ttl is required' FROM part WHERE p_partkey % 31 < 2
"""


def schemes_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_schemes(specs(spark, sf_dir, broken=True), schemes(spark))


_UNKNOWN_SCHEMES_SQL = f"""
SELECT {_ID} AS mapping_id, 'error' AS severity, 'scheme' AS rule, 'Unknown identifier scheme: nope:x' AS detail FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT {_ID}, 'error', 'scheme', 'Unknown identifier scheme: nope:y' FROM part WHERE p_partkey % 29 = 0
"""


def known_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ontology that has only the classes of small parts' types."""
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_type").isin("SMALL", "PROMO", "ECONOMY"))
        .select(F.concat(F.lit(DPA), F.col("p_type")).alias("iri"), F.col("p_type").alias("label"))
        .distinct()
        .withColumn("comment", F.when(F.col("label") == "SMALL", "Small parts").otherwise(""))
    )


def classes_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_classes(mapping_projections(stored_corpus(spark, sf_dir)), known_classes(spark, sf_dir))


_KNOWN = f"('{DPA}SMALL', '{DPA}PROMO', '{DPA}ECONOMY')"
_UNKNOWN_CLASSES_SQL = f"""
WITH f AS ({_F})
SELECT mapping_id, 'warning' AS severity, 'class' AS rule, 'Class not found in ontology: ' || class_iri AS detail
FROM f WHERE class_iri NOT IN {_KNOWN}
"""


def written_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with annotations no generator would write."""
    key = _text("p_partkey")
    odd = case(
        "p_partkey",
        {
            0: F.lit("price:DECIMAL:unsupported"),
            1: F.lit("lonely"),
            2: F.lit(" name : string : a: b "),
            3: F.lit("with:colon:INT:shifted"),
        },
        F.lit("flag:BOOLEAN"),
        5,
    )
    name = case("p_partkey", {0: F.concat(F.lit("two.parts_"), key)}, F.concat(F.lit("unity.hand.t_"), key), 6)
    first = case("p_partkey", {0: F.lit("")}, F.lit('    dpa:unityCatalogColumn "id:INT" ;\n'), 7)
    odd_line = case("p_partkey", {0: F.lit("")}, F.concat(F.lit('    dpa:unityCatalogColumn "'), odd, F.lit('" ;\n')), 7)
    location = case(
        "p_partkey", {0: F.lit("")}, F.concat(F.lit('    dpa:unityCatalogStorageLocation "s3://hand/'), key, F.lit('" ;\n')), 8
    )
    map_class = case("p_partkey", {0: F.lit("")}, F.concat(F.lit("    rr:class dpa:"), F.col("p_type"), F.lit(" ]")), 9)
    return parts(spark, sf_dir).select(
        F.concat(F.lit("hand-"), key).alias("doc_id"),
        F.concat(F.lit("hand-"), key).alias("doc_order"),
        F.concat(
            F.lit(f"@prefix dpa: <{DPA}> .\r\n\r\n<m>\r\n    a rr:TriplesMap ;\n"),
            F.lit('    dpa:unityCatalogObject "'),
            name,
            F.lit('" ;\n'),
            location,
            first,
            odd_line,
            F.lit("    rr:subjectMap [\n"),
            map_class,
            F.lit(" .\n\n<other> a dpa:Nothing .\n<tail> rr:class dpa:Lost"),
        ).alias("text"),
    )


_HAND = """
SELECT p_partkey AS k, p_type, 'hand-' || p_partkey AS mapping_id,
  CASE WHEN p_partkey % 6 = 0 THEN 'two.parts_' || p_partkey ELSE 'unity.hand.t_' || p_partkey END AS full_name,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 's3://hand/' || p_partkey END AS location,
  p_partkey % 7 <> 0 AS has_columns,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Unsupported dpa:unityCatalogColumn type: DECIMAL'
       WHEN p_partkey % 5 = 1 THEN 'Invalid dpa:unityCatalogColumn value: lonely'
       WHEN p_partkey % 5 = 3 THEN 'Unsupported dpa:unityCatalogColumn type: COLON' END AS problem,
  p_partkey % 9 <> 0 AS projects
FROM part
"""


def columns_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_columns(written_by_hand(spark, sf_dir))


_BAD_SQL = f"""
SELECT mapping_id, 'error' AS severity, 'column_annotation' AS rule, problem AS detail FROM ({_HAND}) WHERE projects AND problem IS NOT NULL
"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = validation_summary(written_by_hand(spark, sf_dir), known_classes(spark, sf_dir))
    return made.select("mapping_id", "valid", "projection_count", F.array_join("warnings", "|").alias("warnings"))


_SUMMARY_SQL = f"""
SELECT mapping_id, NOT (projects AND problem IS NOT NULL) AS valid, CAST(projects AS BIGINT) AS projection_count,
  CASE WHEN projects AND '{DPA}' || p_type NOT IN {_KNOWN} THEN 'Class not found in ontology: {DPA}' || p_type ELSE '' END AS warnings
FROM ({_HAND})
"""


def errors_of_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_errors(mapping_projections(written_by_hand(spark, sf_dir)))


_PROJECTION_ERRORS_SQL = f"""
WITH h AS (SELECT * FROM ({_HAND}) WHERE projects AND problem IS NULL)
SELECT mapping_id, 'error' AS severity, 'projection_parts' AS rule,
  'Projection for ' || full_name || ' requires dpa:unityCatalogStorageLocation and at least one dpa:unityCatalogColumn.' AS detail
FROM h WHERE location = '' OR NOT has_columns
UNION ALL
SELECT mapping_id, 'error', 'object_name', 'Unity Catalog object must be catalog.schema.table: ' || full_name FROM h WHERE k % 6 = 0
"""


def shacl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that should have a comment, stated as triples; several parts may state the same."""
    parts = table(spark, sf_dir, "part")
    subject = F.concat(F.lit(DPA), F.regexp_replace("p_name", " ", "-"), F.lit("/"), F.col("p_size").cast("string"))
    commented = (F.col("p_brand") == "Brand#1") | (F.col("p_type") == "SMALL")
    none = F.lit(None).cast("string")
    stated = parts.select(
        F.lit("g").alias("graph"),
        subject.alias("s"),
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(OWL_CLASS).alias("o"), F.lit("uri").alias("o_type")),
                    F.when(
                        commented,
                        F.struct(
                            F.lit(RDFS_COMMENT).alias("p"), F.col("p_brand").alias("o"), F.lit("literal").alias("o_type")
                        ),
                    ),
                )
            )
        ),
    ).select("graph", "s", "p", "o", "o_type", none.alias("o_datatype"), none.alias("o_lang"))
    return shacl_min_count(stated, OWL_CLASS, RDFS_COMMENT, 2, "Say it twice.")


_SHACL_SQL = f"""
SELECT '{DPA}' || replace(p_name, ' ', '-') || '/' || p_size AS focus_node, '{RDFS_COMMENT}' AS path,
  count(DISTINCT p_brand) FILTER (p_brand = 'Brand#1' OR p_type = 'SMALL') AS value_count, 'Say it twice.' AS message
FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) FILTER (p_brand = 'Brand#1' OR p_type = 'SMALL') < 2
"""

_EXPERT_HEAD = f"@prefix rr: <{RR}> .\n@prefix dpa: <{DPA}> .\n"


def expert_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-written document per part; four of five have something that cannot be published."""
    key = _text("p_partkey")
    subject = F.lit(' ; rr:subjectMap [ rr:template "http://ex/{id}" ; rr:class dpa:A , dpa:B ]')
    named = lambda escape: F.concat(
        F.lit(_EXPERT_HEAD + "<m-"), key, F.lit('> a rr:TriplesMap ; dpa:unityCatalogObject "part '), key, F.lit(f'{escape}"'), subject, F.lit(" .\n")
    )
    text = case(
        "p_partkey",
        {
            1: F.concat(named("\\U0001F600"), F.lit('<https://x/owner> <https://x/name> "Ann" .\n')),
            2: F.concat(named("\\U0001F600"), F.lit("<n> a rr:TriplesMap"), subject, F.lit(" ;\n")),
            3: named("\\x"),
            4: F.replace(named("\\U0001F600"), F.lit("rr:"), F.lit("r2:")),
        },
        named("\\U0001F600"),
        5,
    )
    return parts(spark, sf_dir).select(F.concat(F.lit("m-"), key).alias("doc_id"), F.concat(F.lit("m-"), key).alias("doc_order"), text.alias("text"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sound documents say with a name or a text, without the blank nodes between."""
    corpus = stored(expert_corpus(spark, sf_dir), "corpus")
    rejected = rejected_documents(corpus).select(F.col("mapping_id").alias("doc_id")).distinct()
    sound = corpus.join(rejected, "doc_id", "left_anti")
    return document_triples(sound, "g").where(F.col("o_type") != "bnode").groupBy("p", "o", "o_type", "o_datatype").agg(F.count("*").alias("n"))


_REJECTED_SQL = """
SELECT 'm-' || p_partkey AS mapping_id, CASE p_partkey % 5 WHEN 1 THEN 'Statement that is no TriplesMap' WHEN 2 THEN 'Text behind the last statement'
  WHEN 3 THEN 'Unknown escape in a text' ELSE 'Prefix of the mapping vocabulary: r2' END AS problem FROM part WHERE p_partkey % 5 > 0
UNION ALL SELECT 'm-' || p_partkey, unnest(['No TriplesMap found', 'Statement that is no TriplesMap']) FROM part WHERE p_partkey % 5 = 4
"""
_PUBLISHED_SQL = f"""
WITH k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 = 0)
SELECT '{RDF_TYPE}' AS p, '{RR}TriplesMap' AS o, 'uri' AS o_type, CAST(NULL AS VARCHAR) AS o_datatype, count(*) AS n FROM k
UNION ALL SELECT '{RR}template', 'http://ex/{{id}}', 'literal', '{XSD}string', count(*) FROM k
UNION ALL SELECT '{RR}class', '{DPA}' || c, 'uri', NULL, count(*) FROM k, (VALUES ('A'), ('B')) v(c) GROUP BY c
UNION ALL SELECT '{DPA}unityCatalogObject', 'part ' || k || chr(128512), 'literal', '{XSD}string', 1 FROM k
"""

QUERIES = {
    "render_rml": Query(render, _RENDER_SQL),
    "render_broken": Query(render_broken, _RENDER_BROKEN_SQL),
    "ttl_prefixes": Query(prefixes, _PREFIX_SQL),
    "ttl_statements": Query(
        statements,
        f"SELECT mapping_id AS doc_id, CAST(0 AS BIGINT) AS stmt_pos, "
        f"rtrim(substr(rml, strpos(rml, '<mapping-')), chr(10)) AS statement FROM ({_RENDER_SQL})",
    ),
    "ontology_classes": Query(classes, f"SELECT * FROM ({_CLASSES})"),
    "term_lookup": Query(terms, _TERMS_SQL),
    "rejected_documents": Query(lambda spark, sf: rejected_documents(expert_corpus(spark, sf)), _REJECTED_SQL),
    "document_triples": Query(published, _PUBLISHED_SQL),
    "catalog_columns": Query(columns, _COLUMNS_SQL),
    "mapping_projections": Query(projections, _PROJECTIONS_SQL),
    "ontology_summary": Query(
        summary,
        "SELECT count(DISTINCT p_type) + count(DISTINCT p_brand) AS class_count, CAST(3 AS BIGINT) AS identifier_scheme_count FROM part",
    ),
    "validate_specs": Query(validate, _VALIDATE_SQL),
    "unknown_schemes": Query(schemes_unknown, _UNKNOWN_SCHEMES_SQL),
    "unknown_classes": Query(classes_unknown, _UNKNOWN_CLASSES_SQL),
    "bad_columns": Query(columns_bad, _BAD_SQL),
    "validation_summary": Query(summaries, _SUMMARY_SQL),
    "projection_errors": Query(errors_of_projections, _PROJECTION_ERRORS_SQL),
    "shacl_min_count": Query(shacl, _SHACL_SQL),
}
