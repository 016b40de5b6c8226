"""Mapping records. The event log of mappings is made from the events table: each user is a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT_SCHEMA
from ..operators.registry import (
    RECORD_COLUMNS,
    SKETCH_ERROR,
    active_mappings,
    advance,
    current_records,
    current_status,
    dataset_profile,
    documents_of,
    job_overview,
    list_mappings,
    mapping_responses,
    mappings_by_dataset,
    merge_profiles,
    profile_sketches,
    projection_jobs,
    records_of,
    register_batch,
    rml_for_ids,
)
from ..operators.turtle import corpus_of
from ..session import stored
from ..vocab import DPA, PROJECTION_TARGET
from . import documents
from .data import Query, table

_OP = (
    "CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'activate' WHEN 'click' THEN 'update' "
    "WHEN 'purchase' THEN 'deprecate' ELSE 'delete' END"
)
_DATASET = "'unity.default.t_' || (user_id % 10)"
_RML = (
    "'@prefix dpa: <" + DPA + "> .\\n<m-' || event_id || '>\\n    a rr:TriplesMap ;\\n    dpa:unityCatalogObject \"' || "
    + _DATASET
    + " || '\" ;\\n    rr:subjectMap [\\n        rr:class dpa:C' || (event_id % 3) || '\\n    ] .\\n'"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").selectExpr(
        "'map-' || user_id AS mapping_id",
        "event_id AS seq",
        "CAST(ts AS timestamp) AS ts",
        f"{_OP} AS op",
        "CASE WHEN event_id % 3 = 0 THEN 'rml' ELSE 'simple' END AS source",
        "'manufacturing-rdl' AS ontology",
        "CASE WHEN event_id % 3 = 0 THEN 'rml' ELSE 'spark-delta' END AS profile",
        "CASE WHEN event_type = 'signup' THEN 'draft' END AS status",
        f"CASE WHEN event_id % 3 <> 0 THEN '{{\"dataset\":{{\"name\":\"' || {_DATASET} || '\"}}}}' END AS payload",
        f"CASE WHEN event_type IN ('signup', 'click') THEN {_RML} END AS rml",
    )
    return raw.select(*EVENT_SCHEMA.fieldNames())


def _shown(records: DataFrame) -> DataFrame:
    """Times as text, so that no time zone of a reader matters."""
    return records.withColumns(
        {name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") for name in ("created_at", "updated_at")}
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_records(events(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in three parts by time: a state, advanced twice, and stored in between."""
    log = events(spark, sf_dir)
    ends = log.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    third = (ends.b - ends.a) // 3
    state = None
    for begins, until in ((ends.a, ends.a + third), (ends.a + third, ends.a + 2 * third), (ends.a + 2 * third, ends.b + 1)):
        state = stored(advance(state, log.where((F.col("seq") >= begins) & (F.col("seq") < until))), "registry-state")
    return _shown(records_of(state))


_RML_SQL = _RML.replace("\\n", "' || chr(10) || '")
RECORDS_SQL = f"""
WITH e AS (
  SELECT 'map-' || user_id AS id, event_id AS n, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, {_OP} AS op,
    CASE WHEN event_id % 3 = 0 THEN 'rml' ELSE 'simple' END AS source,
    CASE WHEN event_id % 3 = 0 THEN 'rml' ELSE 'spark-delta' END AS profile,
    CASE WHEN event_id % 3 <> 0 THEN '{{"dataset":{{"name":"' || {_DATASET} || '"}}}}' END AS payload,
    {_RML_SQL} AS rml
  FROM events),
birth AS (SELECT id, max(n) AS n FROM e WHERE op = 'register' GROUP BY id),
death AS (SELECT id, max(n) AS n FROM e WHERE op = 'delete' GROUP BY id),
life AS (SELECT b.id, b.n FROM birth b LEFT JOIN death d ON b.id = d.id WHERE d.n IS NULL OR d.n < b.n),
own AS (SELECT e.*, life.n AS born FROM e JOIN life ON e.id = life.id AND e.n >= life.n AND e.op <> 'delete'),
r AS (
  SELECT id, CASE WHEN bool_or(op = 'update') THEN 'rml' ELSE arg_min(source, n) END AS source,
    'manufacturing-rdl' AS ontology, arg_min(profile, n) AS profile,
    COALESCE(CASE arg_max(op, n) FILTER (op IN ('activate', 'deprecate')) WHEN 'activate' THEN 'active' WHEN 'deprecate' THEN 'deprecated' END, 'draft') AS status,
    min(moment) AS created_at, max(moment) AS updated_at,
    max(payload) FILTER (n = born) AS payload,
    arg_max(rml, n) FILTER (op IN ('register', 'update')) AS rml
  FROM own GROUP BY id)
"""


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound declaration becomes a record, numbered by its part."""
    number = F.regexp_extract("mapping_id", "([0-9]+)$", 1)
    made = register_batch(
        documents.specs(spark, sf_dir),
        documents.schemes(spark),
        at=F.to_timestamp(F.lit("2024-01-01 00:00:00")),
        seq=number.cast("bigint"),
        new_id=F.concat(F.lit("map-"), F.lpad(number, 12, "0")),
    )
    return made.select("mapping_id", "seq", "op", "source", "status", "profile", "rml")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ontology = table(spark, sf_dir, "events").select(
        F.concat(F.lit(DPA + "C"), (F.col("event_id") % 2).cast("string")).alias("iri")
    )
    found = records(spark, sf_dir)
    known = ontology.distinct().select("iri", F.lit("").alias("label"), F.lit("").alias("comment"))
    made = mapping_responses(found, corpus_of(documents_of(found)), known)
    return made.select("id", "status", "valid", "projection_count", F.array_join("warnings", "|").alias("warnings"))


_RESPONSES_SQL = f"""{RECORDS_SQL}
SELECT id, status, true AS valid, CAST(1 AS BIGINT) AS projection_count,
  CASE WHEN contains(rml, 'dpa:C2') THEN 'Class not found in ontology: {DPA}C2' ELSE '' END AS warnings
FROM r
"""


def documents_for_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mappings of users who had an expensive event."""
    ids = (
        table(spark, sf_dir, "events")
        .where(F.col("value") > 40)
        .select(F.concat(F.lit("map-"), F.col("user_id").cast("string")).alias("id"))
    )
    return rml_for_ids(records(spark, sf_dir), ids)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projection run per event type, over the mappings it concerns."""
    ids = (
        table(spark, sf_dir, "events")
        .select(F.concat(F.lit("map-"), F.col("user_id").cast("string")).alias("id"), "event_type")
        .distinct()
    )
    log = projection_jobs(
        ids,
        F.concat(F.lit("job-"), F.col("event_type")),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")),
        PROJECTION_TARGET,
    )
    return job_overview(log).drop("created_at")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_profile(table(spark, sf_dir, "orders"))


_PROFILE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS column_name, '{kind}' AS type_name, count(*) AS row_count, "
    f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count FROM orders"
    for name, kind in [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "string"),
        ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "string"),
    ]
)



def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the years of orders, stored apart, merged, and held against exact counts."""
    orders = table(spark, sf_dir, "orders")
    kept = stored(profile_sketches(orders, F.year("o_orderdate")), "profile")
    whole = merge_profiles(kept)
    exact = dataset_profile(orders).select("column_name", F.col("distinct_count").alias("exact_count"))
    near = F.abs(F.col("distinct_count") - F.col("exact_count")) <= F.greatest(F.lit(1.0), SKETCH_ERROR * F.col("exact_count"))
    return whole.join(exact, "column_name").select("column_name", "type_name", "row_count", "null_count", "exact_count", near.alias("near"))


_ALL = ", ".join(RECORD_COLUMNS)
QUERIES = {
    "register_batch": Query(
        register,
        "SELECT 'map-' || lpad(regexp_extract(mapping_id, '([0-9]+)$', 1), 12, '0') AS mapping_id, "
        "CAST(regexp_extract(mapping_id, '([0-9]+)$', 1) AS BIGINT) AS seq, 'register' AS op, 'simple' AS source, "
        f"'draft' AS status, 'spark-delta' AS profile, rml FROM ({documents.QUERIES['render_rml'].sql})",
    ),
    "list_mappings": Query(
        lambda spark, sf: _shown(list_mappings(records(spark, sf))), f"{RECORDS_SQL} SELECT {_ALL} FROM r ORDER BY id"
    ),
    "registry_snapshot": Query(snapshot, f"{RECORDS_SQL} SELECT {_ALL} FROM r"),
    "mappings_by_dataset": Query(
        lambda spark, sf: _shown(mappings_by_dataset(records(spark, sf), "unity.default.t_3")),
        f"{RECORDS_SQL} SELECT {_ALL} FROM r WHERE json_extract_string(payload, '$.dataset.name') = 'unity.default.t_3'",
    ),
    "mapping_response": Query(responses, _RESPONSES_SQL),
    "latest_rml": Query(
        lambda spark, sf: records(spark, sf).select("id", "source", "rml"), f"{RECORDS_SQL} SELECT id, source, rml FROM r"
    ),
    "current_status": Query(
        lambda spark, sf: current_status(events(spark, sf)).withColumn(
            "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ),
        f"{RECORDS_SQL} SELECT id, status, updated_at FROM r",
    ),
    "active_mappings": Query(
        lambda spark, sf: active_mappings(records(spark, sf)).select("id", "rml"),
        f"{RECORDS_SQL} SELECT id, rml FROM r WHERE status = 'active'",
    ),
    "rml_for_ids": Query(
        documents_for_ids,
        f"{RECORDS_SQL} SELECT id AS mapping_id, rml FROM r WHERE id IN (SELECT 'map-' || user_id FROM events WHERE value > 40)",
    ),
    "projection_jobs": Query(
        jobs,
        f"SELECT 'job-' || event_type AS job_id, 'succeeded' AS status, '{PROJECTION_TARGET}' AS target, "
        "count(DISTINCT user_id) AS mapping_count FROM events GROUP BY event_type",
    ),
    "dataset_profile": Query(profile, _PROFILE_SQL),
    "profile_merge": Query(
        profile_merge,
        f"SELECT column_name, type_name, row_count, null_count, distinct_count AS exact_count, true AS near FROM ({_PROFILE_SQL})",
    ),
}
