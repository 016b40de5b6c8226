"""Facts out of a corpus of Turtle documents ``(doc_id, doc_order, text)``.

Documents are cut into statements inside their own row, so a corpus needs no
shuffle up to the point where facts of different documents meet. Prefixes are
shared by the whole corpus; a statement never runs on into the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import (
    catalog_type,
    expand_known_prefix,
    iri_local_part,
    iri_suffixes,
    strip,
    type_json,
    unix_lines,
)
from ..functions.iris import term_prefix
from ..vocab import (
    CLASS_PATTERN,
    COLUMN_PATTERN,
    COMMENT_PATTERN,
    LABEL_PATTERN,
    LOCATION_PATTERN,
    MAP_CLASS_PATTERN,
    OBJECT_NAME_PATTERN,
    PREFIX_PATTERN,
    SKIPPED_LINE,
    STATEMENT,
    WHITESPACE,
)
from .lookup import look_up


def corpus_of(documents: DataFrame) -> DataFrame:
    """Mapping documents as a corpus, in the order of their ids."""
    return documents.select(
        F.col("mapping_id").alias("doc_id"), F.col("mapping_id").alias("doc_order"), F.col("rml").alias("text")
    )


def ttl_prefixes(corpus: DataFrame) -> DataFrame:
    """``(prefix, iri)`` as the corpus declares them; a later declaration wins."""
    found = corpus.where(F.col("text").contains("@prefix")).select(
        "doc_order",
        F.posexplode(F.regexp_extract_all("text", F.lit(PREFIX_PATTERN), F.lit(0))).alias("pos", "declared"),
    )
    return (
        found.select(
            "doc_order",
            "pos",
            F.regexp_extract("declared", PREFIX_PATTERN, 1).alias("prefix"),
            F.regexp_extract("declared", PREFIX_PATTERN, 2).alias("iri"),
        )
        .groupBy("prefix")
        .agg(F.max_by("iri", F.struct("doc_order", "pos")).alias("iri"))
    )


def ttl_statements(corpus: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per statement: lines up to and including one that ends in a full stop.

    Blank lines, comments and prefix lines do not count; what follows the last
    full stop is dropped. With ``keep_empty`` a document without statements
    stays as one row with nulls.
    """

    body = F.regexp_replace(unix_lines(F.col("text")), SKIPPED_LINE, "")
    found = F.filter(
        F.regexp_extract_all(body, F.lit(STATEMENT), F.lit(0)),
        lambda text: F.rtrim(text, F.lit(WHITESPACE)).endswith("."),
    )
    unroll = F.posexplode_outer if keep_empty else F.posexplode
    return corpus.select("doc_id", "doc_order", unroll(found).alias("stmt_pos", "statement"))


def split_statements(lines: DataFrame) -> DataFrame:
    """:func:`ttl_statements` over ``(doc_id, part, line, text)``: documents cut in parts that many tasks read.

    ``part`` orders the parts of a document and ``line`` the lines of a part. How many statements end before a part
    begins is a running sum over one number a part, so a part needs no text of another one; only the lines of a
    statement that runs over a border, or on within a part, meet by its number. No task holds a whole document.
    """
    cut = lines.select("doc_id", "part", "line", F.posexplode(F.split(unix_lines(F.col("text")), "\n")).alias("sub", "text"))
    bare = strip(F.col("text"))
    kept = cut.where((bare != "") & ~bare.startswith("#") & ~bare.startswith("@prefix")).withColumn("ends", bare.endswith("."))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    borders = kept.groupBy("doc_id", "part").agg(F.count_if("ends").alias("ended")).select(
        "doc_id", "part", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("before")
    )
    above = Window.partitionBy("doc_id", "part").orderBy("line", "sub").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.count_if("ends").over(above), F.lit(0))
    numbered = kept.withColumn("own", own).join(borders, ["doc_id", "part"]).withColumn("stmt_pos", F.col("before") + F.col("own"))
    held = F.array_sort(F.collect_list(F.struct("part", "line", "sub", "text")))
    return (
        numbered.groupBy("doc_id", "stmt_pos")
        .agg(held.alias("held"), F.bool_or("ends").alias("ended"))
        .where("ended")
        .select("doc_id", "stmt_pos", F.array_join(F.transform("held", lambda line: line["text"]), "\n").alias("statement"))
    )


def ttl_leftovers(corpus: DataFrame) -> DataFrame:
    """``(doc_id, leftover)`` of documents with text behind their last statement, which :func:`ttl_statements` drops."""
    body = F.regexp_replace(unix_lines(F.col("text")), SKIPPED_LINE, "")
    parts = F.regexp_extract_all(body, F.lit(STATEMENT), F.lit(0))
    ended = lambda text: F.rtrim(text, F.lit(WHITESPACE)).endswith(".")
    open_text = F.array_join(F.filter(parts, lambda text: ~ended(text) & (F.trim(text, F.lit(WHITESPACE)) != "")), "")
    return corpus.select("doc_id", open_text.alias("leftover")).where(F.col("leftover") != "")


def expand_terms(df: DataFrame, term: str, prefixes: DataFrame, into: str) -> DataFrame:
    """Add the IRI of a Turtle term under the corpus prefixes."""
    names = prefixes.select("prefix", F.col("iri").alias("_namespace"))
    found = look_up(df, term_prefix(F.col(term)), names, "prefix")
    return found.withColumn(into, expand_known_prefix(F.col(term), F.col("_namespace"))).drop("_namespace")


def ontology_classes(corpus: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """``(iri, label, comment, first_order, first_pos)`` of the classes a corpus declares.

    The last declaration of an IRI gives its texts, the first its place in the order.
    """
    if prefixes is None:
        prefixes = ttl_prefixes(corpus)
    declared = (
        ttl_statements(corpus)
        .where(F.col("statement").rlike(CLASS_PATTERN))
        .select(
            "doc_order",
            "stmt_pos",
            F.regexp_extract(strip(F.col("statement")), r"(?U)^(\S+)", 1).alias("term"),
            F.nullif(F.regexp_extract("statement", LABEL_PATTERN, 1), F.lit("")).alias("label"),
            F.regexp_extract("statement", COMMENT_PATTERN, 1).alias("comment"),
        )
    )
    place = F.struct("doc_order", "stmt_pos")
    # Declarations of one term are one row before prefixes are looked up; several terms may still name one IRI.
    by_term = declared.groupBy("term").agg(
        F.max_by(F.struct("label", "comment"), place).alias("texts"), F.max(place).alias("at"), F.min(place).alias("first")
    )
    return (
        expand_terms(by_term, "term", prefixes, "iri")
        .groupBy("iri")
        .agg(F.max_by("texts", "at").alias("last"), F.min("first").alias("first"))
        .select(
            "iri",
            F.coalesce("last.label", iri_local_part(F.col("iri"))).alias("label"),
            F.col("last.comment").alias("comment"),
            F.col("first.doc_order").alias("first_order"),
            F.col("first.stmt_pos").alias("first_pos"),
        )
    )


def term_lookup(terms: DataFrame, classes: DataFrame) -> DataFrame:
    """``(term, iri, label, comment)``; ``iri`` is null for a term no class answers to.

    A term is an IRI or its tail behind a ``/`` or ``#``; the first class in
    corpus order wins. Each tail is reduced to its winner before the join.
    """
    tails = classes.select(
        F.explode(F.array_distinct(F.concat(F.array("iri"), iri_suffixes(F.col("iri"))))).alias("tail"),
        F.struct("iri", "label", "comment").alias("found"),
        F.struct("first_order", "first_pos").alias("place"),
    )
    winners = tails.groupBy("tail").agg(F.min_by("found", "place").alias("found"))
    wanted = terms.select("term").distinct()
    return wanted.join(winners, wanted["term"] == winners["tail"], "left").select("term", "found.*")


def _column_structs(statement: Column) -> Column:
    """Column annotations of a statement, each with the reason it is unusable, if any."""
    raw = F.regexp_extract_all(statement, F.lit(COLUMN_PATTERN), F.lit(1))
    parted = F.transform(
        raw,
        lambda text: F.struct(
            text.alias("raw"),
            F.transform(F.split(text, ":", 3), strip).alias("parts"),
        ),
    )
    typed = F.transform(
        parted,
        lambda item: F.struct(
            item["raw"].alias("raw"),
            F.get(item["parts"], F.lit(0)).alias("name"),
            F.upper(F.get(item["parts"], F.lit(1))).alias("type_name"),
            F.coalesce(F.get(item["parts"], F.lit(2)), F.lit("")).alias("comment"),
        ),
    )
    return F.transform(
        typed,
        lambda item, at: F.struct(
            item["name"].alias("name"),
            item["type_name"].alias("type_name"),
            item["comment"].alias("comment"),
            at.cast("int").alias("position"),
            F.when(
                item["type_name"].isNull(),
                F.concat(F.lit("Invalid dpa:unityCatalogColumn value: "), item["raw"]),
            )
            .when(
                catalog_type(item["type_name"]).isNull(),
                F.concat(F.lit("Unsupported dpa:unityCatalogColumn type: "), item["type_name"]),
            )
            .alias("problem"),
        ),
    )


def _catalog_column(column: Column) -> Column:
    """A usable annotation as the catalog wants it."""
    return F.struct(
        column["name"].alias("name"),
        column["type_name"].alias("type_text"),
        type_json(column["name"], catalog_type(column["type_name"])).alias("type_json"),
        column["type_name"].alias("type_name"),
        column["position"].alias("position"),
        F.lit(True).alias("nullable"),
        column["comment"].alias("comment"),
    )


def projection_candidates(corpus: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Statements with what they say about a catalog table, usable or not.

    Statements that name no table or no class are no candidates. With
    ``keep_empty`` they and empty documents stay, marked by a null ``full_name``.
    """
    statements = ttl_statements(corpus, keep_empty=keep_empty)
    if not keep_empty:
        statements = statements.where(F.col("statement").contains("dpa:unityCatalogObject"))
    named = F.nullif(F.regexp_extract("statement", OBJECT_NAME_PATTERN, 1), F.lit(""))
    typed = F.nullif(F.regexp_extract("statement", MAP_CLASS_PATTERN, 1), F.lit(""))
    found = statements.select(
        "doc_id",
        "doc_order",
        "stmt_pos",
        F.when(typed.isNotNull(), named).alias("full_name"),
        typed.alias("class_term"),
        F.coalesce(F.regexp_extract("statement", LOCATION_PATTERN, 1), F.lit("")).alias("storage_location"),
        _column_structs(F.col("statement")).alias("found_columns"),
    )
    return found if keep_empty else found.where(F.col("full_name").isNotNull())


def catalog_columns(corpus: DataFrame) -> DataFrame:
    """Usable catalog columns, one row each."""
    usable = F.filter("found_columns", lambda column: column["problem"].isNull())
    return projection_candidates(corpus).select(
        "doc_id", "full_name", F.inline(F.transform(usable, _catalog_column))
    )


def bad_columns(corpus: DataFrame) -> DataFrame:
    """Column annotations that cannot be used, as validation rows."""
    return (
        projection_candidates(corpus)
        .select("doc_id", F.inline("found_columns"))
        .where(F.col("problem").isNotNull())
        .select(
            F.col("doc_id").alias("mapping_id"),
            F.lit("error").alias("severity"),
            F.lit("column_annotation").alias("rule"),
            F.col("problem").alias("detail"),
        )
    )


def mapping_projections(corpus: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Catalog tables the corpus asks for: name, class, location and columns.

    A statement with an unusable column asks for nothing; :func:`bad_columns` names it.
    """
    if prefixes is None:
        prefixes = ttl_prefixes(corpus)
    usable = projection_candidates(corpus).where(
        ~F.exists("found_columns", lambda column: column["problem"].isNotNull())
    )
    return expand_terms(usable, "class_term", prefixes, "class_iri").select(
        F.col("doc_id").alias("mapping_id"),
        "stmt_pos",
        "full_name",
        "class_iri",
        "storage_location",
        F.transform("found_columns", _catalog_column).alias("columns"),
    )


def ontology_summary(classes: DataFrame, schemes: DataFrame) -> DataFrame:
    """One row: how many classes and identifier schemes there are."""
    counted = classes.select(F.lit("class").alias("kind"), F.col("iri").alias("id")).unionByName(
        schemes.select(F.lit("scheme").alias("kind"), F.col("scheme_id").alias("id"))
    )
    return (
        counted.distinct()
        .groupBy()
        .agg(
            F.count_if(F.col("kind") == "class").alias("class_count"),
            F.count_if(F.col("kind") == "scheme").alias("identifier_scheme_count"),
        )
    )
