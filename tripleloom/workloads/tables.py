"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bucket_of, source_uri, storage_location
from ..operators.turtle import ontology_classes, split_statements, ttl_statements
from ..session import scratch_path
from ..sources import (
    conform,
    parse_schemes,
    publish_graphs,
    read_back_report,
    read_corpus,
    read_corpus_lines,
    read_graphs,
    read_table,
    registered_tables,
    write_table,
)
from ..sources.catalog import current_namespace, list_catalogs, list_schemas
from ..vocab import DPA
from .data import GRAPH, Query, graph_iri, table, triples, with_triples

PERSON = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("city", T.StringType()),
    ]
)


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("city"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("age"),
    )
    return conform(people, PERSON)


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = typed_rows(spark, sf_dir)
    path = scratch_path(spark, "roundtrip")
    write_table(people, path)
    return read_back_report(people, read_table(spark, path))


_DECLARED = (
    "SELECT page_id, replace(split_part(url, '/', 3), '-', '_') AS name, "
    "CASE page_id % 4 WHEN 0 THEN 's3://pages/' || page_id WHEN 1 THEN 'gs://x/s3://y/s3://z' WHEN 2 THEN '' END AS location, "
    "CASE page_id % 3 WHEN 0 THEN 's3a://raw/' || page_id WHEN 1 THEN '' END AS source FROM pages"
)


def storage_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    declared = table(spark, sf_dir, "pages").select(
        "page_id",
        F.replace(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("-"), F.lit("_")).alias("name"),
        F.when(key % 4 == 0, F.concat(F.lit("s3://pages/"), key.cast("string")))
        .when(key % 4 == 1, F.lit("gs://x/s3://y/s3://z"))
        .when(key % 4 == 2, F.lit(""))
        .alias("location"),
        F.when(key % 3 == 0, F.concat(F.lit("s3a://raw/"), key.cast("string"))).when(key % 3 == 1, F.lit("")).alias("source"),
    )
    located = declared.withColumn("storage_location", storage_location(F.col("name"), F.col("location")))
    return located.select(
        "page_id", "storage_location", source_uri(F.col("storage_location"), F.col("source")).alias("source_uri")
    )


_STORAGE_SQL = f"""
WITH d AS ({_DECLARED}),
l AS (SELECT page_id, source, COALESCE(NULLIF(location, ''), 's3://' || replace(name, '.', '/')) AS storage_location FROM d)
SELECT page_id, storage_location,
  COALESCE(NULLIF(source, ''),
    CASE WHEN strpos(storage_location, 's3://') > 0
      THEN substr(storage_location, 1, strpos(storage_location, 's3://') - 1) || 's3a://' ||
           substr(storage_location, strpos(storage_location, 's3://') + 5)
      ELSE storage_location END) AS source_uri
FROM l
"""


def uri_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = (
        F.when(F.col("page_id") % 5 == 0, "s3a:")
        .when(F.col("page_id") % 5 == 1, "S3A:")
        .when(F.col("page_id") % 5 == 2, "s3:")
        .when(F.col("page_id") % 5 == 3, "s3a:/")
        .otherwise("s3a:")
    )
    uris = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(scheme, F.regexp_replace("url", "^https?:", "")).alias("uri")
    )
    found = uris.withColumn("bucket", bucket_of(F.col("uri")))
    return found.select("page_id", "uri", "bucket", F.col("bucket").isNotNull().alias("valid"))


_BUCKET_SQL = """
WITH u AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 's3a:' WHEN 1 THEN 'S3A:' WHEN 2 THEN 's3:' WHEN 3 THEN 's3a:/' ELSE 's3a:' END
         || regexp_replace(url, '^https?:', '') AS uri FROM pages)
SELECT page_id, uri, NULLIF(regexp_extract(uri, '(?i)^s3a://([^/?#]+)', 1), '') AS bucket,
       regexp_matches(uri, '(?i)^s3a://[^/?#]') AS valid
FROM u
"""


def ttl_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class declarations written as text files, read back whole and cut into classes."""
    lines = table(spark, sf_dir, "part").select(
        F.concat(
            F.lit("<" + DPA + "part/"),
            F.col("p_partkey").cast("string"),
            F.lit('> a owl:Class ; rdfs:label "'),
            F.col("p_name"),
            F.lit('" ; rdfs:comment "'),
            F.col("p_brand"),
            F.lit('" .'),
        ).alias("value")
    )
    path = scratch_path(spark, "corpus")
    lines.write.option("maxRecordsPerFile", 1000).text(path)
    corpus = read_corpus(spark, path, pattern="*.txt")
    return ontology_classes(corpus).select("iri", "label", "comment")


def scheme_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry document per supplier; nations are declared again and again, the last one counts."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    own = F.struct(
        F.concat(F.lit("sup:"), key).alias("id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("label"),
        F.concat(F.lit("https://x.example/s/"), key, F.lit("/{value}")).alias("template"),
    )
    shared = F.struct(
        F.concat(F.lit("nat:"), nation).alias("id"),
        F.col("s_name").alias("label"),
        F.concat(F.lit("https://x.example/n/"), key, F.lit("/{value}")).alias("template"),
    )
    documents = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc_order"), F.to_json(F.struct(F.array(own, shared).alias("schemes"))).alias("json")
    )
    return parse_schemes(documents)


_SCHEME_SQL = """
SELECT 'sup:' || s_suppkey AS scheme_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'sup:' || s_suppkey END AS label,
       'https://x.example/s/' || s_suppkey || '/{value}' AS template FROM supplier
UNION ALL
SELECT 'nat:' || s_nationkey, arg_max(s_name, s_suppkey), 'https://x.example/n/' || max(s_suppkey) || '/{value}'
FROM supplier GROUP BY s_nationkey
"""


def publish_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish, then replace one graph; the others keep their triples."""
    path = scratch_path(spark, "graphs")
    publish_graphs(triples(spark, sf_dir, "region", "nation", "customer", shape="rows", dealt=True), path)
    smaller = triples(spark, sf_dir, "customer", shape="rows", dealt=True).where(F.col("p") == DPA + "name")
    publish_graphs(smaller, path)
    publish_graphs(smaller.limit(0), path)
    return read_graphs(spark, path)


def graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graphs")
    publish_graphs(triples(spark, sf_dir, "nation", "customer", "orders", shape="rows", dealt=True), path)
    return read_graphs(spark, path, graph_iri("customer"))


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(f"loom_{name}")
    return registered_tables(spark, prefix="loom_")


def catalog_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's catalog, the schemas made here (one a region) and the current namespace while it is one of them."""
    prefix = f"loom_{uuid.uuid4().hex[:12]}_"
    names = [prefix + row.name for row in table(spark, sf_dir, "region").select(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("name")).collect()]
    before = spark.catalog.currentDatabase()
    try:
        for name in names:
            spark.sql(f"CREATE SCHEMA `{name}`")
        spark.catalog.setCurrentDatabase(min(names))
        rows = [("schema", row.namespace) for row in list_schemas(spark).collect() if row.namespace.startswith(prefix)]
        rows += [("catalog", row.catalog) for row in list_catalogs(spark).collect()]
        rows += [("current", f"{row.catalog}.{row.schema}") for row in current_namespace(spark).collect()]
    finally:
        spark.catalog.setCurrentDatabase(before)
        for name in names:
            spark.sql(f"DROP SCHEMA IF EXISTS `{name}`")
    return spark.createDataFrame([(kind, name.replace(prefix, "")) for kind, name in rows], "kind string, name string")


def ttl_statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut running prose into statements, to see the line rules on texts no tool wrote."""
    corpus = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.col("doc_id").alias("doc_order"), "text"
    )
    return ttl_statements(corpus).select("doc_id", F.col("stmt_pos").cast("bigint").alias("stmt_pos"), "statement")


_WHITE = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)"
    + "".join(f"||chr({code})" for code in [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)
_STATEMENT_LINES_SQL = f"""
WITH w AS (SELECT {_WHITE} AS ws),
split AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM split),
kept AS (SELECT doc_id, n, line, trim(line, ws) AS bare FROM raw, w),
body AS (SELECT * FROM kept WHERE bare <> '' AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '@prefix')),
marked AS (SELECT *, COALESCE(sum(CASE WHEN ends_with(bare, '.') THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM body)
SELECT doc_id, CAST(pos AS BIGINT) AS stmt_pos, string_agg(line, chr(10) ORDER BY n) AS statement
FROM marked GROUP BY doc_id, pos HAVING ends_with(arg_max(bare, n), '.')
"""


def ttl_statements_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as statements over several lines in large files, which are read by byte ranges."""
    key = F.col("p_partkey").cast("string")
    lines = table(spark, sf_dir, "part").select(
        F.concat(F.lit("# Part "), key, F.lit(".\n\n<p/"), key, F.lit("> a dpa:Part ;\n# made by.\n\tdpa:brand \""), F.col("p_brand"), F.lit("\" ;\n    dpa:name \""),
                 F.col("p_name"), F.lit("\" .  ")).alias("value")
    )
    path = scratch_path(spark, "large")
    lines.write.text(path)
    return split_statements(read_corpus_lines(spark, path, pattern="*.txt")).select("statement")


QUERIES = {
    "typed_rows": Query(
        typed_rows,
        "SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, c_nationkey AS age, c_mktsegment AS city FROM customer",
    ),
    "table_roundtrip": Query(
        table_roundtrip,
        "SELECT count(*) AS written_rows, count(*) AS read_rows, CAST(0 AS BIGINT) AS missing_rows, "
        "CAST(0 AS BIGINT) AS extra_rows FROM customer",
    ),
    "storage_defaults": Query(storage_defaults, _STORAGE_SQL),
    "uri_bucket": Query(uri_bucket, _BUCKET_SQL),
    "ttl_corpus": Query(
        ttl_corpus,
        f"SELECT '{DPA}part/' || p_partkey AS iri, p_name AS label, p_brand AS comment FROM part",
    ),
    "scheme_registry": Query(scheme_registry, _SCHEME_SQL),
    "publish_graph": Query(
        publish_graph,
        with_triples("region", "nation", "customer")
        + f"SELECT * FROM t WHERE graph <> '{GRAPH}customer' OR p = '{DPA}name'",
    ),
    "graph_scan": Query(graph_scan, with_triples("customer") + "SELECT * FROM t"),
    "catalog_listing": Query(
        catalog_listing,
        "\nUNION ALL\n".join(f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in TABLES),
    ),
    "catalog_namespaces": Query(
        catalog_namespaces,
        "WITH r AS (SELECT replace(lower(r_name), ' ', '_') AS name FROM region) SELECT 'schema' AS kind, name FROM r "
        "UNION ALL SELECT 'catalog', 'spark_catalog' UNION ALL SELECT 'current', 'spark_catalog.' || min(name) FROM r",
    ),
    "ttl_statement_lines": Query(ttl_statement_lines, _STATEMENT_LINES_SQL),
    "ttl_statements_split": Query(
        ttl_statements_split,
        "SELECT '<p/' || p_partkey || '> a dpa:Part ;' || chr(10) || chr(9) || 'dpa:brand \"' || p_brand || '\" ;' || chr(10) || "
        "'    dpa:name \"' || p_name || '\" .  ' AS statement FROM part",
    ),
}
