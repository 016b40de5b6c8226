"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    catalog_type,
    column_annotation,
    escape_literal,
    expand_curie,
    iri_label,
    iri_safe,
    lexical_form,
    preview_id,
    record_id,
    safe_name,
    type_json,
    xsd_datatype,
)
from ..operators.graph import list_graphs
from ..operators.sampling import monte_carlo_pi, point_from_hash
from ..operators.turtle import expand_terms
from ..vocab import CATALOG_TYPE, DPA, XSD, XSD_LOCAL_BY_TYPE
from .data import GRAPH, Query, table

_SHORT_SQL = (
    "CASE p_partkey % 6 WHEN 0 THEN 'http://x.example/' || p_name WHEN 1 THEN 'dpa:' || p_name WHEN 2 THEN 'xsd:' || p_type "
    "WHEN 3 THEN 'mfg:' || p_brand || ':' || p_size WHEN 4 THEN p_name ELSE '' END"
)


def expand_curie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SHORT_SQL).alias("short"))
    return parts.select("p_partkey", "short", expand_curie(F.col("short")).alias("iri"))


_CURIE_SQL = f"""
WITH x AS (SELECT p_partkey, {_SHORT_SQL} AS short FROM part)
SELECT p_partkey, short, CASE
  WHEN starts_with(short, 'http://') OR starts_with(short, 'https://') THEN short
  WHEN starts_with(short, 'dpa:') THEN '{DPA}' || substr(short, 5)
  WHEN starts_with(short, 'xsd:') THEN '{XSD}' || substr(short, 5)
  WHEN strpos(short, ':') > 0 THEN '{DPA}' || substr(short, 1, strpos(short, ':') - 1) || '/' || substr(short, strpos(short, ':') + 1)
  ELSE '{DPA}' || short END AS iri
FROM x
"""

_TERM_SQL = (
    "CASE p_partkey % 5 WHEN 0 THEN '  <https://x.example/' || p_type || '> ' WHEN 1 THEN lower(p_type) || ':' || p_name "
    "WHEN 2 THEN 'none:' || p_name WHEN 3 THEN p_name ELSE lower(p_type) || ':a:b ' END"
)


def expand_term_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part type declares a prefix; other prefixes stay unknown."""
    parts = table(spark, sf_dir, "part")
    prefixes = (
        parts.groupBy(F.lower("p_type").alias("prefix"))
        .agg(F.max("p_brand").alias("brand"))
        .select("prefix", F.concat(F.lit("https://x.example/"), F.col("brand"), F.lit("/")).alias("iri"))
    )
    terms = parts.select("p_partkey", F.expr(_TERM_SQL).alias("term"))
    return expand_terms(terms, "term", prefixes, "iri").select("p_partkey", "iri")


_EXPAND_TERM_SQL = f"""
WITH p AS (SELECT lower(p_type) AS prefix, 'https://x.example/' || max(p_brand) || '/' AS iri FROM part GROUP BY 1),
x AS (SELECT p_partkey, trim({_TERM_SQL}) AS term FROM part)
SELECT p_partkey, CASE
  WHEN starts_with(term, '<') AND ends_with(term, '>') THEN substr(term, 2, length(term) - 2)
  WHEN p.iri IS NOT NULL THEN p.iri || substr(term, strpos(term, ':') + 1)
  ELSE term END AS iri
FROM x LEFT JOIN p ON strpos(term, ':') > 0 AND p.prefix = split_part(term, ':', 1)
"""

_TYPES = [*XSD_LOCAL_BY_TYPE, "BINARY", "DECIMAL", "BIGINT", "ARRAY"]
_TYPE_SQL = (
    "CASE event_id % "
    + str(len(_TYPES) + 1)
    + "".join(f" WHEN {i} THEN '{name if i % 2 else name.lower()}'" for i, name in enumerate(_TYPES))
    + " ELSE event_type END"
)


def xsd_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "events").select("event_id", F.expr(_TYPE_SQL).alias("type_name"))
    return typed.select(
        "event_id",
        xsd_datatype(F.col("type_name")).alias("datatype"),
        catalog_type(F.upper("type_name")).alias("json_type"),
    )


_XSD_SQL = (
    f"WITH x AS (SELECT event_id, upper({_TYPE_SQL}) AS t FROM events) SELECT event_id, '{XSD}' || CASE t"
    + "".join(f" WHEN '{name}' THEN '{local}'" for name, local in XSD_LOCAL_BY_TYPE.items())
    + " ELSE 'string' END AS datatype, CASE t"
    + "".join(f" WHEN '{name}' THEN '{local}'" for name, local in CATALOG_TYPE.items())
    + " END AS json_type FROM x"
)


def safe_name_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


def escape_literal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, whose markup is full of quotes and line ends."""
    return table(spark, sf_dir, "pages").select("page_id", escape_literal(F.col("html")).alias("escaped"))


_ANNOTATED = (
    "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name, "
    "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(p_type) END AS type_name, "
    "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_brand || ': ' || p_size END AS comment FROM part"
)


def column_annotation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(key % 9 != 0, F.col("p_name")).alias("name"),
        F.when(key % 4 == 1, "").when(key % 4 > 1, F.lower("p_type")).alias("type_name"),
        F.when(key % 5 == 0, "")
        .when(key % 5 > 1, F.concat(F.col("p_brand"), F.lit(": "), F.col("p_size").cast("string")))
        .alias("comment"),
    )
    return parts.select(
        "p_partkey", column_annotation(F.col("name"), F.col("type_name"), F.col("comment")).alias("annotation")
    )


def iri_safe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in four languages, and addresses full of reserved characters."""
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), iri_safe(F.col("text")).alias("safe")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), iri_safe(F.col("url")).alias("safe")
    )
    return documents.unionByName(pages)


_IRI_SAFE_SQL = r"""
WITH x AS (SELECT 'document' AS kind, doc_id AS id, text AS v FROM documents UNION ALL SELECT 'page', page_id, url FROM pages)
SELECT kind, id, array_to_string(list_transform(
  regexp_extract_all(v, '[\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}\x{10000}-\x{1FFFD}]+|[^\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}\x{10000}-\x{1FFFD}]+'),
  lambda r: CASE WHEN regexp_matches(r, '^[\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}\x{10000}-\x{1FFFD}]') THEN r ELSE url_encode(r) END), '') AS safe
FROM x
"""


def lexical_form_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns(
        {
            "day": F.to_date("ts"),
            "flag": F.col("event_type") == "error",
            "money": F.col("value").cast("decimal(12,3)"),
            "small": F.col("user_id").try_cast("smallint"),
            "bytes": F.col("event_type").cast("binary"),
        }
    )
    types = {field.name: field.dataType for field in events.schema.fields}
    forms = {
        name: lexical_form(F.col(name), types[name])
        for name in ("ts", "day", "flag", "value", "money", "small", "bytes", "event_type")
    }
    # A user beyond the small type keeps the text of its own type.
    forms["small"] = F.coalesce(forms["small"], lexical_form(F.col("user_id"), types["user_id"]))
    return events.select("event_id", *[form.alias(f"{name}_text") for name, form in forms.items()])


def iri_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    marked = F.concat(
        F.col("url"), F.when(key % 4 == 0, ">").when(key % 4 == 1, "#").when(key % 4 == 2, "/").otherwise("")
    )
    return table(spark, sf_dir, "pages").select("page_id", iri_label(marked).alias("label"))


_LABEL_SQL = """
WITH x AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '>' WHEN 1 THEN '#' WHEN 2 THEN '/' ELSE '' END AS v FROM pages)
SELECT page_id, regexp_extract(regexp_replace(v, '[>#]$', ''), '([^#/]*)$', 1) AS label FROM x
"""


def preview_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part("url", F.lit("/"), F.lit(3))
    name = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 5 != 1, host)
    return table(spark, sf_dir, "pages").select("page_id", preview_id(name).alias("mapping_id"))


def record_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    reference = (
        F.when(key % 3 == 0, F.concat(F.lit("map-"), user))
        .when(key % 3 == 1, F.to_json(F.struct(F.lit("draft").alias("status"), F.concat(F.lit("map-"), user).alias("id"))))
        .otherwise(F.col("props"))
    )
    found = table(spark, sf_dir, "events").select("event_id", record_id(reference).alias("mapping_id"))
    return found.select("event_id", "mapping_id", F.col("mapping_id").isNotNull().alias("valid"))


def type_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit(' "'), F.col("p_brand"), F.lit('"'))
    return table(spark, sf_dir, "part").select("p_partkey", type_json(name, F.lower("p_type")).alias("type_json"))


def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs named after hosts, filtered by a text in another case."""
    named = table(spark, sf_dir, "pages").select(
        F.concat(F.lit(GRAPH), F.initcap(F.split_part("url", F.lit("/"), F.lit(3)))).alias("graph")
    )
    return list_graphs(named, containing="EXAMPLE.net")


def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line is one sample; its keys give the point."""
    lines = table(spark, sf_dir, "lineitem")
    key = [F.col(name).cast("string") for name in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return monte_carlo_pi(lines, *point_from_hash(*key))


_KEY_SQL = "l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber"
_PI_SQL = f"""
WITH d AS (SELECT md5({_KEY_SQL}) AS h FROM lineitem),
s AS (SELECT ('0x' || substr(h, 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS x,
             ('0x' || substr(h, 9, 8))::UBIGINT::DOUBLE / 4294967296.0 AS y FROM d),
c AS (SELECT count(*) AS sample_count, count(*) FILTER (x * x + y * y <= 1.0) AS inside_count FROM s)
SELECT sample_count, inside_count, 4.0::DOUBLE * inside_count / sample_count AS pi FROM c
"""

QUERIES = {
    "expand_curie": Query(expand_curie_query, _CURIE_SQL),
    "expand_term": Query(expand_term_query, _EXPAND_TERM_SQL),
    "xsd_type": Query(xsd_type, _XSD_SQL),
    "safe_name": Query(
        safe_name_query, "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g') AS name FROM pages"
    ),
    "escape_literal": Query(
        escape_literal_query,
        "SELECT page_id, replace(replace(html, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') AS escaped FROM pages",
    ),
    "column_annotation": Query(
        column_annotation_query,
        f"WITH x AS ({_ANNOTATED}) SELECT p_partkey, concat_ws(':', NULLIF(name, ''), "
        "upper(COALESCE(NULLIF(type_name, ''), 'STRING')), NULLIF(comment, '')) AS annotation FROM x",
    ),
    "iri_safe": Query(iri_safe_query, _IRI_SAFE_SQL),
    "lexical_form": Query(
        lexical_form_query,
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_text, strftime(ts, '%Y-%m-%d') AS day_text, "
        "CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS flag_text, CAST(value AS VARCHAR) AS value_text, "
        "CAST(CAST(value AS DECIMAL(12,3)) AS VARCHAR) AS money_text, CAST(user_id AS VARCHAR) AS small_text, "
        "hex(event_type) AS bytes_text, event_type AS event_type_text FROM events",
    ),
    "iri_label": Query(iri_label_query, _LABEL_SQL),
    "preview_id": Query(
        preview_id_query,
        "SELECT page_id, 'mapping-' || replace(CASE WHEN page_id % 5 < 2 THEN 'dataset' ELSE split_part(url, '/', 3) END, "
        "'.', '-') AS mapping_id FROM pages",
    ),
    "record_id": Query(
        record_id_query,
        "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'map-' || user_id ELSE json_extract_string(props, '$.id') END "
        "AS mapping_id, event_id % 3 < 2 OR json_extract_string(props, '$.id') IS NOT NULL AS valid FROM events",
    ),
    "type_json": Query(
        type_json_query,
        """SELECT p_partkey, '{"name":"' || p_name || ' \\"' || p_brand || '\\"","type":"' || lower(p_type) ||
        '","nullable":true,"metadata":{}}' AS type_json FROM part""",
    ),
    "graph_filter": Query(
        graph_filter,
        f"SELECT DISTINCT '{GRAPH}' || upper(substr(h, 1, 1)) || substr(h, 2) AS graph FROM "
        "(SELECT split_part(url, '/', 3) AS h FROM pages) WHERE contains(lower(h), 'example.net')",
    ),
    "monte_carlo_pi": Query(monte_carlo, _PI_SQL),
}
