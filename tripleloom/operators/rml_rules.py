"""Mapping documents back to runnable mappings.

Handles the constructs that :mod:`.render` writes, in any layout. What uses
anything else, or names the mapping vocabularies by other prefixes, is reported
by :func:`rejected_documents`, not half-run and not half-published.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expand_known_prefix
from ..functions.iris import term_prefix
from ..plans import MappingPlan, TripleRule
from ..vocab import DPA, PREFIX_PATTERN, RDF_TYPE, RML, RR, TRIPLE_COLUMNS, XSD
from .turtle import expand_terms, ttl_leftovers, ttl_prefixes, ttl_statements

_QUOTED = r'"((?:[^"\\]|\\.)*)"'
_TERM = r"(<[^>]*>|[^\s;\]\[]+)"
_INNER = r'((?:[^\]\["]|"(?:[^"\\]|\\.)*")*)'
_MAP = rf"(?U)rr:predicateObjectMap\s*\[\s*rr:predicate\s+{_TERM}\s*;\s*(?:rr:object\s+{_TERM}|rr:objectMap\s*\[{_INNER}\])\s*;?\s*\]"
_SUBJECT = rf"(?U)rr:subjectMap\s*\[{_INNER}\]"
_SOURCE = rf"(?U)rml:logicalSource\s*\[{_INNER}\]"
_KNOWN_TERMS = (
    "rr:TriplesMap rr:subjectMap rr:template rr:class rr:predicateObjectMap rr:predicate rr:objectMap "
    "rr:object rr:datatype rml:logicalSource rml:source rml:referenceFormulation rml:reference"
).split()


_ANNOTATIONS = "dpa:unityCatalogObject dpa:unityCatalogStorageLocation dpa:unityCatalogColumn".split()
# Where a statement names a property: behind its subject, behind a bracket or a semicolon.
_PROPERTY = r"(?U)(?:^\s*\S+|[;\[])\s*([\w-]*:[\w-]+)"
_CLASS_LIST = rf"(?U)rr:class\s+{_TERM}((?:\s*,\s*{_TERM})*)"


# Escapes of Turtle, and one that is none of them: an unknown letter, too few digits, or no code point.
_CODE = r"\\u[0-9A-Fa-f]{4}|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
_PIECE = rf"(?s)(?:\\u[0-9A-Fa-f]{{4}})+|{_CODE}|\\.|[^\\]+"
_BAD_ESCAPE = rf"(?s)^(?:[^\\]|{_CODE}|\\[tbnrf\"'\\])*+.+$"
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: Column) -> Column:
    """The characters that a quoted text stands for."""

    def read(piece: Column) -> Column:
        letter = F.substr(piece, F.lit(2), F.lit(1))
        plain = F.coalesce(*[F.when(letter == name, F.lit(char)) for name, char in _LETTERS.items()], letter)
        # Runs of short codes are read together: two of them may be one character.
        short = F.decode(F.unhex(F.replace(piece, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        long = F.decode(F.unhex(F.substr(piece, F.lit(3))), "UTF-32")
        return F.when(~piece.startswith("\\"), piece).when(piece.rlike(r"^\\u"), short).when(piece.rlike(r"^\\U"), long).otherwise(plain)

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), read), "")
    return F.when(text.contains("\\") & ~text.rlike(_BAD_ESCAPE), whole).otherwise(text)


def _quoted_after(text: Column, name: str) -> Column:
    value = F.regexp_extract(text, rf"(?U){name}\s+{_QUOTED}", 1)
    return F.when(text.rlike(rf"(?U){name}\s+{_QUOTED}"), _unescaped(value))


def _term_after(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?U){name}\s+{_TERM}", 1), F.lit(""))


def triples_maps(corpus: DataFrame) -> DataFrame:
    """One row per TriplesMap: its source, subject and rules, with IRIs still in short form.

    ``problem`` says why a map cannot be run; then the other columns do not count.
    """
    statement = F.col("statement")
    bare = F.regexp_replace(statement, r'"(?:[^"\\]|\\.)*"|<[^>]*>', "")
    used = F.regexp_extract_all(bare, F.lit(r"(?U)\b(?:rr|rml):\w+"), F.lit(0))
    properties = F.regexp_extract_all(F.regexp_replace(statement, r'"(?:[^"\\]|\\.)*"', '""'), F.lit(_PROPERTY), F.lit(1))
    maps = F.regexp_extract_all(statement, F.lit(_MAP), F.lit(0))
    subject = F.regexp_extract(statement, _SUBJECT, 1)
    classes = F.regexp_extract_all(subject, F.lit(_CLASS_LIST), F.lit(0))
    found = (
        ttl_statements(corpus)
        .where(statement.contains("rr:subjectMap"))
        .select(
            F.col("doc_id").alias("mapping_id"),
            "stmt_pos",
            F.regexp_extract(statement, r"(?U)^\s*(\S+)", 1).alias("map_term"),
            _quoted_after(statement, "dpa:unityCatalogObject").alias("object_name"),
            _quoted_after(statement, "dpa:unityCatalogStorageLocation").alias("storage_location"),
            F.transform(
                F.regexp_extract_all(statement, F.lit(rf"(?U)dpa:unityCatalogColumn\s+{_QUOTED}"), F.lit(1)), _unescaped
            ).alias("annotations"),
            _quoted_after(F.regexp_extract(statement, _SOURCE, 1), "rml:source").alias("source_uri"),
            _term_after(F.regexp_extract(statement, _SOURCE, 1), "rml:referenceFormulation").alias("formulation"),
            _quoted_after(subject, "rr:template").alias("subject_template"),
            F.array_distinct(
                F.flatten(F.transform(classes, lambda text: F.regexp_extract_all(F.regexp_replace(text, "^rr:class", ""), F.lit(r"<[^>]*>|[^\s,]+"), F.lit(0))))
            ).alias("class_terms"),
            F.transform(
                maps,
                lambda text: F.struct(
                    _term_after(text, "rr:predicate").alias("predicate"),
                    _term_after(text, "rr:object").alias("object"),
                    _quoted_after(text, "rml:reference").alias("reference"),
                    _term_after(text, "rr:datatype").alias("datatype"),
                    _quoted_after(text, "rr:template").alias("template"),
                ),
            ).alias("rules"),
            F.array_except(
                F.array_union(used, properties), F.array(*[F.lit(term) for term in [*_KNOWN_TERMS, *_ANNOTATIONS]])
            ).alias("unknown"),
            (bare.rlike(r"\]\s*,") | F.contains(statement, F.lit(f"<{RR}")) | F.contains(statement, F.lit(f"<{RML}"))).alias("other_form"),
            F.exists(F.regexp_extract_all(statement, F.lit(_QUOTED), F.lit(1)), lambda text: text.rlike(_BAD_ESCAPE)).alias("bad_escape"),
            (F.size(maps) == F.size(F.filter(used, lambda term: term == "rr:predicateObjectMap"))).alias("all_read"),
        )
    )
    problem = (
        F.when(
            F.size("unknown") > 0,
            F.concat(F.lit("Unsupported construct: "), F.array_join(F.array_sort("unknown"), ", ")),
        )
        .when(~F.col("all_read"), F.lit("Unreadable predicate-object map"))
        .when(F.col("other_form"), F.lit("List of objects or vocabulary without prefix"))
        .when(F.col("bad_escape"), F.lit("Unknown escape in a text"))
        .when(F.col("subject_template").isNull(), F.lit("Subject map without template"))
    )
    return found.withColumn("problem", problem).drop("unknown", "all_read", "other_form", "bad_escape")


def _slot(template: str) -> tuple[str, str]:
    """Column and ``{value}`` form of a template that uses one column."""
    columns = set(re.findall(r"\{([^{}]+)\}", template))
    if len(columns) != 1:
        raise ValueError(f"Template must use exactly one column: {template}")
    column = columns.pop()
    return column, template.replace("{" + column + "}", "{value}")


def rejected_documents(corpus: DataFrame) -> DataFrame:
    """``(mapping_id, problem)`` of each document that cannot be turned into triples as a whole.

    A document is rejected for a map with a problem, for a prefix that gives a
    mapping vocabulary another name or its name to something else, for a
    statement that is no map, for text behind its last full stop, and if it has
    no map at all.
    """
    declared = corpus.select(F.col("doc_id").alias("mapping_id"), F.explode(F.regexp_extract_all("text", F.lit(PREFIX_PATTERN), F.lit(0))).alias("line"))
    prefix, iri = F.regexp_extract("line", PREFIX_PATTERN, 1), F.regexp_extract("line", PREFIX_PATTERN, 2)
    usual = F.when(prefix == "rr", F.lit(RR)).when(prefix == "rml", F.lit(RML))
    wrong = (iri != F.coalesce(usual, iri)) | (iri.isin(RR, RML) & usual.isNull())
    renamed = declared.where(wrong).select("mapping_id", F.concat(F.lit("Prefix of the mapping vocabulary: "), prefix).alias("problem"))
    maps = triples_maps(corpus)
    bad = maps.where(F.col("problem").isNotNull()).select("mapping_id", "problem")
    empty = (
        corpus.select(F.col("doc_id").alias("mapping_id"))
        .join(maps.select("mapping_id").distinct(), "mapping_id", "left_anti")
        .select("mapping_id", F.lit("No TriplesMap found").alias("problem"))
    )
    others = ttl_statements(corpus).where(~F.col("statement").contains("rr:subjectMap"))
    no_maps = others.select(F.col("doc_id").alias("mapping_id"), F.lit("Statement that is no TriplesMap").alias("problem"))
    unended = ttl_leftovers(corpus).select(F.col("doc_id").alias("mapping_id"), F.lit("Text behind the last statement").alias("problem"))
    return renamed.union(bad).union(empty).union(no_maps).union(unended).distinct()


def plan_batches(corpus: DataFrame, size: int = 200, by_source: bool = False) -> Iterator[list[tuple[str, str | None, MappingPlan]]]:
    """``(mapping_id, source_uri, plan)`` of each TriplesMap, in document order, ``size`` of them at a time.

    Plans are needed on the driver before a job can be put together; it holds
    one batch of them, however many maps the corpus has. Raises ``ValueError``
    for a map that cannot be run. ``by_source`` orders maps by their source first, so that those of one table meet in
    a batch and can share its scan.
    """
    terms = F.concat(
        F.col("class_terms"), F.flatten(F.transform("rules", lambda rule: F.array(rule["predicate"], rule["object"], rule["datatype"])))
    )
    maps = triples_maps(corpus).withColumn("terms", F.array_distinct(terms))
    wanted = maps.select("mapping_id", "stmt_pos", F.explode("terms").alias("term")).where("term is not null")
    known = ttl_prefixes(corpus).select(F.col("prefix").alias("_prefix"), F.col("iri").alias("_namespace"))
    # Each distinct term meets its prefix once, however many maps use it.
    resolved = wanted.select("term").distinct().join(known, term_prefix(F.col("term")) == F.col("_prefix"), "left").select(
        "term", expand_known_prefix(F.col("term"), F.col("_namespace")).alias("iri")
    )
    of_map = wanted.join(resolved, "term").groupBy("mapping_id", "stmt_pos").agg(F.map_from_entries(F.collect_list(F.struct("term", "iri"))).alias("iris"))
    rows = maps.drop("terms").join(of_map, ["mapping_id", "stmt_pos"], "left")
    rows = rows.orderBy(*["source_uri"] * by_source, "mapping_id", "stmt_pos").toLocalIterator()
    while batch := list(islice(rows, size)):
        yield [_plan_of(row) for row in batch]


def _plan_of(row) -> tuple[str, str | None, MappingPlan]:
    if row.problem:
        raise ValueError(f"{row.mapping_id}: {row.problem}")
    iri_of = row.iris or {}
    key, template = _slot(row.subject_template)
    rules = [TripleRule(RDF_TYPE, "uri", constant=iri_of[term]) for term in row.class_terms]
    for rule in row.rules:
        predicate = iri_of[rule.predicate]
        if rule.object is not None:
            rules.append(TripleRule(predicate, "uri", constant=iri_of[rule.object]))
        elif rule.template is not None:
            column, pattern = _slot(rule.template)
            rules.append(TripleRule(predicate, "uri", column=column, template=pattern))
        elif rule.reference is not None:
            datatype = iri_of[rule.datatype] if rule.datatype else None
            rules.append(TripleRule(predicate, "literal", column=rule.reference, datatype=datatype))
        else:
            raise ValueError(f"{row.mapping_id}: object map without reference, template or object")
    return row.mapping_id, row.source_uri, MappingPlan(key, template, tuple(rules))


def plans_from_rml(corpus: DataFrame) -> list[tuple[str, str | None, MappingPlan]]:
    """All plans of a corpus at once, for one that is known to be small."""
    return [plan for batch in plan_batches(corpus) for plan in batch]


def document_triples(corpus: DataFrame, graph: str, prefixes: DataFrame | None = None) -> DataFrame:
    """The mapping documents themselves as triples, to be published and queried.

    Documents that :func:`rejected_documents` names are not, or not wholly,
    among them. Nested parts become blank nodes named after their place, so the same
    document gives the same triples again.
    """
    if prefixes is None:
        prefixes = ttl_prefixes(corpus)
    maps = expand_terms(triples_maps(corpus).where(F.col("problem").isNull()), "map_term", prefixes, "map_iri")
    node = F.concat(F.lit("_:m"), F.md5(F.concat_ws("\u0000", F.col("mapping_id"), F.col("stmt_pos").cast("string"))))
    maps = maps.withColumn("node", node)
    s, source, subject = F.col("map_iri"), F.concat("node", F.lit("s")), F.concat("node", F.lit("t"))

    def fact(where: Column, predicate: str, value: Column, kind: str) -> Column:
        return F.struct(where.alias("s"), F.lit(predicate).alias("p"), value.alias("raw"), F.lit(kind).alias("kind"))

    whole = F.array(
        fact(s, RDF_TYPE, F.lit(f"<{RR}TriplesMap>"), "term"),
        fact(s, DPA + "unityCatalogObject", F.col("object_name"), "literal"),
        fact(s, DPA + "unityCatalogStorageLocation", F.col("storage_location"), "literal"),
        fact(s, RML + "logicalSource", F.when(F.col("source_uri").isNotNull(), source), "bnode"),
        fact(source, RML + "source", F.col("source_uri"), "literal"),
        fact(source, RML + "referenceFormulation", F.col("formulation"), "term"),
        fact(s, RR + "subjectMap", subject, "bnode"),
        fact(subject, RR + "template", F.col("subject_template"), "literal"),
    )
    classes = F.transform("class_terms", lambda term: fact(subject, RR + "class", term, "term"))
    annotations = F.transform(
        "annotations", lambda text: fact(s, DPA + "unityCatalogColumn", text, "literal")
    )

    def of_rule(rule: Column, at: Column) -> Column:
        here = F.concat(F.col("node"), F.lit("p"), at.cast("string"))
        there = F.concat(F.col("node"), F.lit("o"), at.cast("string"))
        return F.array(
            fact(s, RR + "predicateObjectMap", here, "bnode"),
            fact(here, RR + "predicate", rule["predicate"], "term"),
            fact(here, RR + "object", rule["object"], "term"),
            fact(here, RR + "objectMap", F.when(rule["object"].isNull(), there), "bnode"),
            fact(there, RML + "reference", rule["reference"], "literal"),
            fact(there, RR + "template", rule["template"], "literal"),
            fact(there, RR + "datatype", rule["datatype"], "term"),
        )

    facts = maps.select(
        F.inline(F.concat(whole, classes, annotations, F.flatten(F.transform("rules", of_rule)))).alias("s", "p", "raw", "kind")
    ).where(F.col("raw").isNotNull())
    terms = facts.withColumn("term", F.when(F.col("kind") == "term", F.col("raw")))
    resolved = expand_terms(terms, "term", prefixes, "iri")
    return (
        resolved.select(
            F.lit(graph).alias("graph"),
            "s",
            "p",
            F.coalesce("iri", "raw").alias("o"),
            F.when(F.col("kind") == "term", "uri").otherwise(F.col("kind")).alias("o_type"),
            F.when(F.col("kind") == "literal", F.lit(XSD + "string")).alias("o_datatype"),
            F.lit(None).cast("string").alias("o_lang"),
        )
        .select(*TRIPLE_COLUMNS)
        .distinct()
    )
