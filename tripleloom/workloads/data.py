"""Mappings of the test tables, and the same triples as SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Mapper, MappingSpec
from ..operators.materialize import materialize_all
from ..plans import MappingPlan, plan_mapping
from ..session import spread
from ..vocab import DPA, RDF_TYPE, XSD


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


RESOURCE = "https://data-pipeline.local/resource/"
GRAPH = "https://data-pipeline.local/graph/"
SCHEMES = {
    f"res:{name}": f"{RESOURCE}{name}/{{value}}"
    for name in ("region", "nation", "customer", "orders", "lineitem", "part", "event", "user")
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _declare() -> dict[str, MappingSpec]:
    mapper = Mapper()

    def dataset(name: str, rdf_class: str, key: str, scheme: str):
        return (
            mapper.dataset(f"unity.default.{name}")
            .row_subject(rdf_class=rdf_class)
            .subject_identifier(column=key, scheme=f"res:{scheme}")
            .storage(source_uri=f"s3a://tables/{name}")
        )

    built = {
        "region": dataset("region", "dpa:Region", "r_regionkey", "region")
        .column("r_name")
        .literal(predicate="dpa:name"),
        "nation": dataset("nation", "dpa:Nation", "n_nationkey", "nation")
        .column("n_name")
        .literal(predicate="dpa:name")
        .column("n_regionkey", "INT")
        .entity_reference(scheme="res:region", predicate="dpa:inRegion"),
        "customer": dataset("customer", "dpa:Customer", "c_custkey", "customer")
        .column("c_name")
        .literal(predicate="dpa:name")
        .column("c_acctbal", "DOUBLE")
        .literal(predicate="dpa:accountBalance")
        .column("c_mktsegment")
        .classification(term="dpa:MarketSegment")
        .column("c_nationkey", "INT")
        .entity_reference(scheme="res:nation", predicate="dpa:inNation"),
        "orders": dataset("orders", "dpa:Order", "o_orderkey", "orders")
        .column("o_totalprice", "DOUBLE")
        .literal(predicate="dpa:totalPrice")
        .column("o_orderdate", "TIMESTAMP")
        .literal(predicate="dpa:orderDate")
        .column("o_orderstatus")
        .literal(predicate="dpa:orderStatus")
        .column("o_custkey", "LONG")
        .entity_reference(scheme="res:customer", predicate="dpa:placedBy"),
        "lineitem": dataset("lineitem", "dpa:OrderLine", "l_orderkey", "lineitem")
        .column("l_partkey", "LONG")
        .entity_reference(scheme="res:part", predicate="dpa:part")
        .column("l_returnflag")
        .literal(predicate="dpa:returnFlag"),
        "events": dataset("events", "dpa:Event", "event_id", "event")
        .column("ts", "TIMESTAMP")
        .literal(predicate="dpa:at")
        .column("event_type")
        .literal(predicate="dpa:eventType")
        .column("user_id", "LONG")
        .entity_reference(scheme="res:user", predicate="dpa:byUser"),
    }
    return {name: builder.spec() for name, builder in built.items()}


SPECS = _declare()


#: Tables of a few rows at any size of the others.
SMALL = ("region", "nation")


def plan(name: str) -> MappingPlan:
    return plan_mapping(SPECS[name], SCHEMES)


def graph_iri(name: str) -> str:
    return GRAPH + name


def triples(spark: SparkSession, sf_dir: str, *names: str, shape: str = "branches", dealt: bool = False) -> DataFrame:
    """Triples of the named tables. ``dealt``: of rows in all tasks, for what holds the triples a task makes, as a set does."""

    def rows(name: str) -> DataFrame:
        found = table(spark, sf_dir, name)
        return spread(found, plan(name).subject_column) if dealt and name not in SMALL else found

    return materialize_all([(rows(name), plan(name), graph_iri(name)) for name in names], shape=shape)


# -- the same triples in SQL ---------------------------------------------------------------------

_T = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"
_FACTS: dict[str, tuple[str, str, list[tuple[str, str, str | None]]]] = {
    "region": ("r_regionkey", "region", [("type", f"'{DPA}Region'", None), ("name", "r_name", "string")]),
    "nation": (
        "n_nationkey",
        "nation",
        [
            ("type", f"'{DPA}Nation'", None),
            ("name", "n_name", "string"),
            ("inRegion", f"'{RESOURCE}region/' || n_regionkey", None),
        ],
    ),
    "customer": (
        "c_custkey",
        "customer",
        [
            ("type", f"'{DPA}Customer'", None),
            ("name", "c_name", "string"),
            ("accountBalance", "CAST(c_acctbal AS VARCHAR)", "double"),
            ("classifiedAs", f"'{DPA}MarketSegment'", None),
            ("inNation", f"'{RESOURCE}nation/' || c_nationkey", None),
        ],
    ),
    "orders": (
        "o_orderkey",
        "orders",
        [
            ("type", f"'{DPA}Order'", None),
            ("totalPrice", "CAST(o_totalprice AS VARCHAR)", "double"),
            ("orderDate", _T.format("o_orderdate"), "dateTime"),
            ("orderStatus", "o_orderstatus", "string"),
            ("placedBy", f"'{RESOURCE}customer/' || o_custkey", None),
        ],
    ),
    "lineitem": (
        "l_orderkey",
        "lineitem",
        [
            ("type", f"'{DPA}OrderLine'", None),
            ("part", f"'{RESOURCE}part/' || l_partkey", None),
            ("returnFlag", "l_returnflag", "string"),
        ],
    ),
    "events": (
        "event_id",
        "event",
        [
            ("type", f"'{DPA}Event'", None),
            ("at", _T.format("ts"), "dateTime"),
            ("eventType", "event_type", "string"),
            ("byUser", f"'{RESOURCE}user/' || user_id", None),
        ],
    ),
}


def triples_sql(*names: str, only: tuple[str, ...] | None = None) -> str:
    """A SELECT of the triples of the named tables, of some predicates only if given."""
    selects = []
    for name in names:
        key, kind, facts = _FACTS[name]
        for local, value, datatype in facts:
            if only is not None and local not in only:
                continue
            predicate = RDF_TYPE if local == "type" else DPA + local
            datatype_sql = f"'{XSD}{datatype}'" if datatype else "CAST(NULL AS VARCHAR)"
            selects.append(
                f"SELECT '{graph_iri(name)}' AS graph, '{RESOURCE}{kind}/' || {key} AS s, "
                f"'{predicate}' AS p, {value} AS o, '{'literal' if datatype else 'uri'}' AS o_type, "
                f"{datatype_sql} AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM {name}"
            )
    return "\nUNION ALL\n".join(selects)


def with_triples(*names: str) -> str:
    return f"WITH t AS (\n{triples_sql(*names)}\n)\n"


# -- short cuts shared by the query modules -------------------------------------------------------


def case(key: str, mapping: dict[int, Column], otherwise: Column, modulus: int) -> Column:
    """A value chosen by ``key % modulus``."""
    chosen = otherwise
    for rest, value in mapping.items():
        chosen = F.when(F.col(key) % modulus == rest, value).otherwise(chosen)
    return chosen
