"""Mapping execution, in batch and on streams."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Mapper, schemes_frame, specs_frame
from ..operators.materialize import (
    dangling_keys,
    dangling_references,
    distinct_triples,
    materialize,
    materialize_distinct,
    materialize_many,
    untyped_values,
)
from ..operators.render import render_rml
from ..operators.registry import active_mappings, current_records, documents_of, register_batch
from ..operators.rml_rules import plan_batches, plans_from_rml
from ..operators.turtle import corpus_of
from ..plans import plan_mapping
from ..session import scratch_path, stored
from ..sources.buckets import BucketedStore, buckets_for
from ..streaming import GraphSink, distinct_stream, materialize_stream, read_table_stream, run_available, run_into_graph
from ..vocab import DPA, RDF_TYPE, XSD
from . import lifecycle
from .data import (
    RESOURCE,
    SCHEMES,
    SPECS,
    Query,
    graph_iri,
    plan,
    table,
    triples,
    triples_sql,
    with_triples,
)


def _one(name: str, predicate: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return materialize(table(spark, sf_dir, name), plan(name), graph_iri(name), predicate=predicate)

    return run


def subject_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of documents by a key that is null for some rows and needs escaping in others."""
    documents = table(spark, sf_dir, "documents").select(
        F.when(
            F.col("doc_id") % 7 != 0,
            F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit(" "), F.col("doc_id").cast("string")),
        ).alias("doc key")
    )
    spec = (
        Mapper()
        .dataset("unity.default.documents")
        .row_subject(rdf_class="dpa:Document")
        .subject_identifier(column="doc key", scheme="doc")
        .spec()
    )
    made = plan_mapping(spec, {"doc": "https://x.example/d/{value}/it"})
    return materialize(documents, made, graph_iri("documents")).select("s")


def ignored_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = (
        Mapper()
        .dataset("unity.default.supplier")
        .row_subject(rdf_class="dpa:Supplier")
        .subject_identifier(column="s_suppkey", scheme="sup")
        .column("s_name")
        .literal(predicate="dpa:name")
        .column("s_acctbal", "DOUBLE")
        .ignore()
        .column("s_nationkey", "INT")
        .ignore()
        .spec()
    )
    made = plan_mapping(spec, {"sup": RESOURCE + "supplier/{value}"})
    return materialize(table(spark, sf_dir, "supplier"), made, graph_iri("supplier")).select("s", "p", "o")


def null_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null key drops the row, a null literal or link its triple, a null classified column nothing."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.when(key % 10 != 0, key).alias("c_custkey"),
        F.when(key % 3 != 0, F.col("c_name")).alias("c_name"),
        "c_acctbal",
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(key % 4 != 0, F.col("c_nationkey")).alias("c_nationkey"),
    )
    return materialize(customers, plan("customer"), graph_iri("customer"))


def materialize_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(table(spark, sf_dir, "orders"), plan("orders"), graph_iri("orders"))


_TYPED = (
    Mapper()
    .dataset("unity.default.orders")
    .row_subject(rdf_class="dpa:Order")
    .subject_identifier(column="o_orderkey", scheme="res:orders")
    .column("o_orderdate", "DATE")
    .literal(predicate="dpa:day")
    .column("o_totalprice", "INT")
    .literal(predicate="dpa:wholePrice")
    .column("o_shippriority", "BOOLEAN")
    .literal(predicate="dpa:urgent")
    .column("o_custkey", "DOUBLE")
    .literal(predicate="dpa:customerNumber")
    .spec()
)


def _odd_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose prices are whole at every third key, and with a flag of 0, 1 or 2."""
    price = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", price.alias("o_totalprice"), (F.col("o_orderkey") % 3).cast("int").alias("o_shippriority"), "o_custkey"
    )


def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals in the form of their declared datatype, which is not that of the column."""
    made = materialize(_odd_orders(spark, sf_dir), plan_mapping(_TYPED, SCHEMES), graph_iri("orders"))
    return made.where(F.col("o_type") == "literal").select("s", "p", "o", "o_datatype")


def subject_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of the customer with the highest key."""
    customers = table(spark, sf_dir, "customer")
    key = customers.agg(F.max("c_custkey").alias("k")).first().k
    return materialize(
        customers, plan("customer"), graph_iri("customer"), shape="branches", subject=f"{RESOURCE}customer/{key}"
    )


TURNS = ("region", "nation", "customer", "orders")
#: Mappings of each table in the log of :func:`materialize_active`.
VARIANTS = 3


def materialize_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All active mappings of a log of events, as the log's documents say, each into a graph named after its record.

    Three mappings of each of four tables are registered; users' views activate and their purchases deprecate the
    mapping whose turn it is. Mappings of one table share its scan.
    """
    specs = [replace(SPECS[name], name=f"{SPECS[name].name}_{v}") for v in range(VARIANTS) for name in TURNS]
    number = {spec.name: F.lit(i) for i, spec in enumerate(specs)}
    at = F.element_at(F.create_map(*[x for name, i in number.items() for x in (F.lit(name), i)]), F.col("dataset.name"))
    born = F.to_timestamp(F.lit("2000-01-01 00:00:00"))
    log = register_batch(specs_frame(spark, specs), schemes_frame(spark, SCHEMES), at=born, seq=at, new_id=F.concat(F.lit("map-"), at))
    status = lifecycle.events(spark, sf_dir).where("op in ('activate', 'deprecate')")
    user = F.regexp_extract("mapping_id", "([0-9]+)$", 1).cast("int")
    log = log.unionByName(status.withColumn("mapping_id", F.concat(F.lit("map-"), user % len(specs))))
    active = stored(documents_of(active_mappings(current_records(log))), "active")
    jobs: dict[str, list] = {}
    for batch in plan_batches(corpus_of(active), by_source=True):
        for mapping_id, uri, made in batch:
            jobs.setdefault(uri.rsplit("/", 1)[-1], []).append((made, graph_iri(mapping_id)))
    parts = [materialize_many(table(spark, sf_dir, name), of_table) for name, of_table in jobs.items()]
    return reduce(DataFrame.unionByName, parts) if parts else triples(spark, sf_dir, *TURNS).where("false")


MANY = 1000


def materialize_many_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand mappings of the suppliers, in one scan: classes, predicates, links and graphs differ."""

    def spec(i: int):
        return (
            Mapper()
            .dataset(f"unity.default.supplier_{i}")
            .row_subject(rdf_class=f"dpa:Supplier{i % 7}")
            .subject_identifier(column="s_suppkey", scheme=f"sup{i % 3}")
            .column("s_name")
            .literal(predicate=f"dpa:name{i % 10}")
            .column("s_nationkey", "INT")
            .entity_reference(scheme="nat", predicate="dpa:inNation")
            .spec()
        )

    schemes = {f"sup{n}": f"{RESOURCE}supplier{n}/{{value}}" for n in range(3)} | {"nat": RESOURCE + "nation/{value}"}
    jobs = [(plan_mapping(spec(i), schemes), graph_iri(f"many/{i}")) for i in range(MANY)]
    return materialize_many(table(spark, sf_dir, "supplier"), jobs)


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize_distinct(table(spark, sf_dir, "lineitem"), plan("lineitem"), graph_iri("lineitem"))


def distinct_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same set from finished triples, for graphs that no mapping made."""
    return distinct_triples(triples(spark, sf_dir, "lineitem", shape="rows"))


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a graph that describes the customers of one segment only."""
    links = materialize(table(spark, sf_dir, "orders"), plan("orders"), graph_iri("orders"), predicate=DPA + "placedBy")
    households = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "HOUSEHOLD")
    known = materialize(households, plan("customer"), graph_iri("customer"), predicate=RDF_TYPE)
    return dangling_references(links, known)


def dangling_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question, answered on keys."""
    households = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "HOUSEHOLD")
    return dangling_keys(table(spark, sf_dir, "orders"), plan("orders"), DPA + "placedBy", households, plan("customer"))


_DANGLING_SQL = (
    f"SELECT '{DPA}placedBy' AS p, '{RESOURCE}customer/' || o_custkey AS o, count(*) AS reference_count FROM orders "
    "WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD') GROUP BY o_custkey"
)


def materialize_rml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render the customer mapping as a document, read the document back, run what it says."""
    documents = render_rml(specs_frame(spark, [SPECS["customer"]]), schemes_frame(spark, SCHEMES))
    [(_, _, read)] = plans_from_rml(corpus_of(documents))
    return materialize(table(spark, sf_dir, "customer"), read, graph_iri("customer"))


def stream_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = read_table_stream(spark, f"{sf_dir}/events.parquet*", schema)
    made = materialize_stream(rows, plan("events"), graph_iri("events"))
    return run_available(made, scratch_path(spark, "stream"), scratch_path(spark, "offsets"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and what they did, stated by every event and kept once."""
    spec = (
        Mapper()
        .dataset("unity.default.users")
        .row_subject(rdf_class="dpa:User")
        .subject_identifier(column="user_id", scheme="res:user")
        .column("event_type")
        .literal(predicate="dpa:did")
        .spec()
    )
    schema = table(spark, sf_dir, "events").schema
    rows = read_table_stream(spark, f"{sf_dir}/events.parquet*", schema)
    made = distinct_stream(rows, plan_mapping(spec, SCHEMES), graph_iri("users"), "ts", "60 days")
    stored = run_available(made, scratch_path(spark, "stream"), scratch_path(spark, "offsets"))
    return stored.select("s", "p", "o", "o_type", "o_datatype")


#: Events arrive in the order of their time, purchases ten days later; a file for every quarter of the time.
_ARRIVES = "ts + (CASE WHEN event_type = 'purchase' THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END)"
_FILES, _DELAY = 4, "2 days"


def _arriving(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    """The events as files in the order of their arrival."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min(F.expr(_ARRIVES)).alias("a"), F.max(F.expr(_ARRIVES)).alias("b")).first()
    width = (ends.b - ends.a) / _FILES
    folder = scratch_path(spark, "arrivals")
    arrives = F.expr(_ARRIVES)
    for i in range(_FILES):
        begins, until = F.lit(ends.a + i * width), F.lit(ends.a + (i + 1) * width)
        within = (arrives >= begins) & ((arrives < until) if i + 1 < _FILES else F.lit(True))
        events.where(within).repartition(1).write.mode("append").parquet(f"{folder}/{i}")
    return f"{folder}/*", events.schema


def _streamed(spark: SparkSession, sf_dir: str, times: int) -> tuple[GraphSink, T.StructType]:
    path, schema = _arriving(spark, sf_dir)
    state = scratch_path(spark, "sink")
    made = table(spark, sf_dir, "events").count() * len(plan("events").rules)
    store = BucketedStore(spark, f"{state}/graphs", buckets_for(made))
    sink = GraphSink(store, plan("events"), graph_iri("events"), "ts", _DELAY, state)
    for _ in range(times):
        rows = read_table_stream(spark, path, schema, files_per_batch=1)
        run_into_graph(rows, sink, scratch_path(spark, "offsets"))
    return sink, schema


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that came more than two days behind what earlier batches had brought."""
    sink, schema = _streamed(spark, sf_dir, 1)
    found = sink.late(spark, schema)
    return found.select("event_id", "event_type", "batch_id", F.date_format("missed", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("missed"))


def stream_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in time, streamed into a graph and replayed from the start: one graph."""
    sink, _ = _streamed(spark, sf_dir, 2)
    return sink.store.read()


_LATE = f"""
WITH a AS (SELECT *, {_ARRIVES} AS arrives FROM events),
x AS (SELECT min(arrives) AS first, epoch_us(max(arrives)) - epoch_us(min(arrives)) AS span FROM a),
b AS (SELECT a.*, CAST(least({_FILES - 1}, (epoch_us(arrives) - epoch_us(first)) * {_FILES} // span) AS BIGINT) AS batch_id FROM a, x),
w AS (SELECT i AS batch_id, (SELECT max(ts) FROM b WHERE b.batch_id < i) - INTERVAL 2 DAY AS missed FROM range({_FILES}) r(i)),
l AS (SELECT b.*, missed, coalesce(ts < missed, false) AS late FROM b JOIN w USING (batch_id))
"""

_NULL_RULES = f"""
WITH c AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS n,
                  c_acctbal AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS nk FROM customer),
t AS (
  SELECT k, '{RDF_TYPE}' AS p, '{DPA}Customer' AS o, 'uri' AS o_type, NULL AS o_datatype FROM c
  UNION ALL SELECT k, '{DPA}name', n, 'literal', '{XSD}string' FROM c
  UNION ALL SELECT k, '{DPA}accountBalance', CAST(a AS VARCHAR), 'literal', '{XSD}double' FROM c
  UNION ALL SELECT k, '{DPA}classifiedAs', '{DPA}MarketSegment', 'uri', NULL FROM c
  UNION ALL SELECT k, '{DPA}inNation', '{RESOURCE}nation/' || nk, 'uri', NULL FROM c)
SELECT '{graph_iri("customer")}' AS graph, '{RESOURCE}customer/' || k AS s, p, o, o_type, o_datatype,
       CAST(NULL AS VARCHAR) AS o_lang
FROM t WHERE k IS NOT NULL AND o IS NOT NULL
"""

_USERS = f"""
SELECT DISTINCT '{RESOURCE}user/' || user_id AS s, '{RDF_TYPE}' AS p, '{DPA}User' AS o, 'uri' AS o_type,
       CAST(NULL AS VARCHAR) AS o_datatype FROM events
UNION ALL
SELECT DISTINCT '{RESOURCE}user/' || user_id, '{DPA}did', event_type, 'literal', '{XSD}string' FROM events
"""

QUERIES = {
    "subject_iri": Query(
        subject_iri,
        "SELECT 'https://x.example/d/' || url_encode(lang || '/' || source || ' ' || doc_id) || '/it' AS s "
        "FROM documents WHERE doc_id % 7 <> 0",
    ),
    "type_triples": Query(_one("orders", RDF_TYPE), triples_sql("orders", only=("type",))),
    "literal_triples": Query(_one("orders", DPA + "orderDate"), triples_sql("orders", only=("orderDate",))),
    "entity_ref_triples": Query(_one("orders", DPA + "placedBy"), triples_sql("orders", only=("placedBy",))),
    "classification_triples": Query(
        _one("customer", DPA + "classifiedAs"), triples_sql("customer", only=("classifiedAs",))
    ),
    "ignored_column": Query(
        ignored_column,
        f"SELECT '{RESOURCE}supplier/' || s_suppkey AS s, '{RDF_TYPE}' AS p, '{DPA}Supplier' AS o FROM supplier "
        f"UNION ALL SELECT '{RESOURCE}supplier/' || s_suppkey, '{DPA}name', s_name FROM supplier",
    ),
    "null_rules": Query(null_rules, _NULL_RULES),
    "materialize_mapping": Query(materialize_mapping, triples_sql("orders")),
    "subject_bound": Query(
        subject_bound,
        with_triples("customer")
        + f"SELECT * FROM t WHERE s = (SELECT '{RESOURCE}customer/' || max(c_custkey) FROM customer)",
    ),
    "materialize_active": Query(
        materialize_active,
        with_triples(*TURNS).rstrip()
        + f""", e AS (SELECT user_id % {VARIANTS * len(TURNS)} AS i, arg_max(event_type, event_id) AS last
          FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1)
        SELECT t.* REPLACE ('{graph_iri("map-")}' || i AS graph) FROM t
        JOIN e ON last = 'view' AND list_position({[graph_iri(name) for name in TURNS]}, graph) - 1 = i % {len(TURNS)}""",
    ),
    "lexical_by_datatype": Query(
        typed_literals,
        f"""WITH r AS (SELECT '{RESOURCE}orders/' || o_orderkey AS s, o_orderkey % 3 AS k, o_orderdate AS d, o_custkey AS c,
          CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS price FROM orders)
        SELECT s, '{DPA}day' AS p, strftime(d, '%Y-%m-%d') AS o, '{XSD}date' AS o_datatype FROM r
        UNION ALL SELECT s, '{DPA}wholePrice', CAST(CAST(price AS BIGINT) AS VARCHAR), '{XSD}integer' FROM r WHERE price = floor(price)
        UNION ALL SELECT s, '{DPA}urgent', CASE WHEN k = 1 THEN 'true' ELSE 'false' END, '{XSD}boolean' FROM r WHERE k < 2
        UNION ALL SELECT s, '{DPA}customerNumber', CAST(c AS VARCHAR), '{XSD}double' FROM r""",
    ),
    "untyped_values": Query(
        lambda spark, sf: untyped_values(_odd_orders(spark, sf), plan_mapping(_TYPED, SCHEMES)),
        f"""SELECT 'o_totalprice' AS "column", '{XSD}integer' AS datatype, count(*) AS "rows" FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice <> floor(o_totalprice)
        UNION ALL SELECT 'o_shippriority', '{XSD}boolean', count(*) FROM orders WHERE o_orderkey % 3 = 2""",
    ),
    "materialize_many": Query(
        materialize_many_maps,
        f"""WITH m AS (SELECT '{graph_iri("many/")}' || i AS graph, '{RESOURCE}supplier' || i % 3 || '/' || s_suppkey AS s, i, s_name, s_nationkey
          FROM supplier, range({MANY}) r(i))
        SELECT graph, s, '{RDF_TYPE}' AS p, '{DPA}Supplier' || i % 7 AS o, 'uri' AS o_type, CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM m
        UNION ALL SELECT graph, s, '{DPA}name' || i % 10, s_name, 'literal', '{XSD}string', NULL FROM m
        UNION ALL SELECT graph, s, '{DPA}inNation', '{RESOURCE}nation/' || s_nationkey, 'uri', NULL, NULL FROM m""",
    ),
    "distinct_triples": Query(distinct, with_triples("lineitem") + "SELECT DISTINCT * FROM t"),
    "distinct_triples_plain": Query(distinct_plain, with_triples("lineitem") + "SELECT DISTINCT * FROM t"),
    "dangling_refs": Query(dangling_refs, _DANGLING_SQL),
    "dangling_keys": Query(dangling_by_key, _DANGLING_SQL),
    "materialize_rml": Query(materialize_rml, triples_sql("customer")),
    "stream_materialize": Query(stream_materialize, triples_sql("events")),
    "stream_distinct": Query(stream_distinct, _USERS),
    "stream_late": Query(
        stream_late, _LATE + "SELECT event_id, event_type, batch_id, strftime(missed, '%Y-%m-%d %H:%M:%S.%f') AS missed FROM l WHERE late"
    ),
    "stream_graph": Query(
        stream_graph,
        _LATE + ", t AS (" + triples_sql("events") + f") SELECT t.* FROM t JOIN l ON s = '{RESOURCE}event/' || event_id WHERE NOT late",
    ),
}
