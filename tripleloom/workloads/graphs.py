"""Questions to the graphs of regions, nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import (
    Literal,
    Pattern,
    bgp_join,
    bindings,
    bindings_rows,
    bindings_variant,
    bound_cells,
    class_counts,
    clear_graph,
    complete_triples,
    construct,
    delete_data,
    delete_where,
    describe_node,
    exists,
    graph_counts,
    graph_edges,
    graph_nodes,
    graph_sample,
    insert_data,
    list_graphs,
    minus,
    node_degrees,
    not_exists,
    number,
    object_number,
    optional,
    predicate_stats,
    solutions,
    table_view,
    top_k,
    triple_pattern,
    union,
)
from ..operators.condensation import path_components
from ..operators.paths import path_closure
from ..operators.stars import bgp_star, characteristic_sets
from ..operators.updates import insert_into, update_graphs, update_where
from ..session import scratch_path
from ..sources import publish_graphs, read_graphs
from ..sources.buckets import BucketedStore, buckets_for
from ..vocab import DPA, RDF_TYPE, XSD
from .data import GRAPH, RESOURCE, Query, graph_iri, plan, table, triples, with_triples

PEOPLE = ("region", "nation", "customer")
ALL_TABLES = (*PEOPLE, "orders")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For questions that bind a predicate: only its columns are read."""
    return triples(spark, sf_dir, *PEOPLE)


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir, *ALL_TABLES)


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For questions about all triples: one scan for each table."""
    return triples(spark, sf_dir, *ALL_TABLES, shape="rows")


def _stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored query result per customer: two rows, the second with nothing bound to o at times."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    uri = lambda text: F.struct(F.lit("uri").alias("type"), text.alias("value"))
    first = F.struct(
        uri(F.concat(F.lit(RESOURCE + "customer/"), key)).alias("s"),
        uri(F.lit(DPA + "name")).alias("p"),
        F.struct(F.lit("literal").alias("type"), F.col("c_name").alias("value")).alias("o"),
    )
    second = F.struct(
        uri(F.concat(F.lit(RESOURCE + "customer/"), key)).alias("s"),
        uri(F.lit(DPA + "segment")).alias("p"),
        F.when(
            F.col("c_mktsegment") != "BUILDING",
            F.struct(
                F.lit("literal").alias("type"),
                F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("value"),
            ),
        ).alias("o"),
    )
    document = F.struct(
        F.struct(F.array(*[F.lit(name) for name in "spo"]).alias("vars")).alias("head"),
        F.struct(F.array(first, second).alias("bindings")).alias("results"),
    )
    return customer.select(F.col("c_custkey").alias("result_id"), F.to_json(document).alias("json"))


def bindings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bindings_rows(_stored_results(spark, sf_dir), ["s", "p", "o"])
    return rows.withColumn("row_index", F.col("row_index").cast("bigint"))


_RESULT_ROWS = f"""
SELECT c_custkey AS result_id, CAST(0 AS BIGINT) AS row_index, '{RESOURCE}customer/' || c_custkey AS s, 'uri' AS s_type,
  '{DPA}name' AS p, 'uri' AS p_type, c_name AS o, 'literal' AS o_type FROM customer
UNION ALL
SELECT c_custkey, 1, '{RESOURCE}customer/' || c_custkey, 'uri', '{DPA}segment', 'uri',
  CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN 'literal' END FROM customer
"""


def bindings_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results whose variables nobody names: every bound cell."""
    cells = bound_cells(bindings_variant(_stored_results(spark, sf_dir)))
    return cells.withColumn("row_index", F.col("row_index").cast("bigint"))


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_triples(bindings_query(spark, sf_dir)).select("s", "p", "o", "o_type")


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_view(bindings_query(spark, sf_dir), ["s", "p", "o"])


_DRAWN = with_triples("customer") + (
    ", d AS (SELECT *, row_number() OVER (ORDER BY s, p, o) - 1 AS place FROM t ORDER BY s, p, o LIMIT 150)"
)
_LABEL = "regexp_extract(regexp_replace({0}, '[>#]$', ''), '([^#/]*)$', 1)"
_NODES_SQL = f"""{_DRAWN},
x AS (SELECT s AS id, 'subject' AS type, 2 * place AS seen FROM d
      UNION ALL SELECT o, CASE WHEN o_type = 'uri' THEN 'resource' ELSE 'literal' END, 2 * place + 1 FROM d)
SELECT id, {_LABEL.format('id')} AS label, arg_min(type, seen) AS type FROM x GROUP BY id
"""


def paths_to_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per region, by way of their nations."""
    found = bgp_join(
        people(spark, sf_dir),
        [
            Pattern("?customer", DPA + "inNation", "?nation"),
            Pattern("?nation", DPA + "inRegion", "?region"),
            Pattern("?region", DPA + "name", "?region_name"),
        ],
    )
    return found.groupBy("region_name").agg(F.count("*").alias("customer_count"))


def with_rich_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = people(spark, sf_dir)
    nations = bgp_join(graph, [Pattern("?nation", RDF_TYPE, DPA + "Nation"), Pattern("?nation", DPA + "name", "?name")])
    rich = bgp_join(
        graph,
        [Pattern("?customer", DPA + "accountBalance", "?balance"), Pattern("?customer", DPA + "inNation", "?nation")],
    ).where(number("balance") > 9900)
    return solutions(optional(nations, rich)).select("name", "customer", "balance")


def _orders_of(graph: DataFrame, status: str) -> DataFrame:
    return bgp_join(
        graph,
        [Pattern("?order", DPA + "placedBy", "?customer"), Pattern("?order", DPA + "orderStatus", Literal(status))],
    )


def without_dear_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = everything(spark, sf_dir)
    homes = bgp_join(graph, [Pattern("?customer", DPA + "inNation", "?nation")])
    orders = bgp_join(
        graph, [Pattern("?order", DPA + "placedBy", "?customer"), Pattern("?order", DPA + "totalPrice", "?price")]
    )
    return solutions(not_exists(homes, orders.where(number("price") > 300000)))


def with_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = everything(spark, sf_dir)
    names = bgp_join(graph, [Pattern("?customer", DPA + "inNation", "?nation")])
    return solutions(exists(names, _orders_of(graph, "P")))


def minus_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = everything(spark, sf_dir)
    names = bgp_join(graph, [Pattern("?customer", DPA + "inNation", "?nation")])
    return solutions(minus(names, _orders_of(graph, "P")))


def union_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their regions, and regions; what a part does not bind is null."""
    graph = people(spark, sf_dir)
    nations = bgp_join(graph, [Pattern("?it", DPA + "inRegion", "?region"), Pattern("?it", DPA + "name", "?name")])
    regions = bgp_join(graph, [Pattern("?it", RDF_TYPE, DPA + "Region"), Pattern("?it", DPA + "name", "?name")])
    return solutions(union(nations, regions, regions)).distinct()


def dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest orders after the first five."""
    graph = everything(spark, sf_dir)
    priced = bgp_join(
        graph, [Pattern("?order", DPA + "totalPrice", "?price"), Pattern("?order", DPA + "placedBy", "?customer")]
    )
    return solutions(top_k(priced, [number("price").desc(), F.col("order")], limit=10, offset=5))


def balance_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bgp_join(
        people(spark, sf_dir),
        [
            Pattern("?customer", DPA + "accountBalance", "?balance"),
            Pattern("?customer", DPA + "inNation", "?nation"),
            Pattern("?nation", DPA + "name", "?name"),
        ],
    )
    amount = number("balance", "decimal(20,2)")
    summed = found.groupBy("name").agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
    return summed.where(F.col("total") > 0).select("name", "n", F.col("total").cast("double").alias("total"))


def region_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct links from customers to regions, and the customers' names with them."""
    found = bgp_join(
        people(spark, sf_dir),
        [
            Pattern("?customer", DPA + "inNation", "?nation"),
            Pattern("?nation", DPA + "inRegion", "?region"),
            Pattern("?customer", DPA + "name", "?name"),
        ],
    )
    return construct(
        found,
        [
            Pattern("?customer", DPA + "livesIn", "?region"),
            Pattern("?region", DPA + "knows", "?name"),
            Pattern("?region", DPA + "kind", Literal("inhabited", XSD + "string")),
        ],
        GRAPH + "derived",
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_node(whole(spark, sf_dir), RESOURCE + "nation/0")


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where orders lead, over customers and nations to regions."""
    links = everything(spark, sf_dir).where(
        F.col("p").isin(DPA + "placedBy", DPA + "inNation", DPA + "inRegion")
    )
    return path_closure(links.select(F.col("s").alias("source"), F.col("o").alias("target")))


_LINKS = with_triples(*ALL_TABLES) + (
    f", l AS (SELECT s, o FROM t WHERE p IN ('{DPA}placedBy', '{DPA}inNation', '{DPA}inRegion'))"
)


def closure_from_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p*`` against the links: who is in each nation, who ordered, and the nation itself."""
    links = everything(spark, sf_dir).where(F.col("p").isin(DPA + "placedBy", DPA + "inNation"))
    starts = triple_pattern(people(spark, sf_dir), Pattern("?s", RDF_TYPE, DPA + "Nation"))
    return path_closure(
        links.select(F.col("o").alias("source"), F.col("s").alias("target")),
        sources=starts.select(F.col("s").alias("start")),
        include_start=True,
    )


def closure_to_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p+`` with a bound end: what leads to the regions, walked backwards from them."""
    links = everything(spark, sf_dir).where(F.col("p").isin(DPA + "placedBy", DPA + "inNation", DPA + "inRegion"))
    ends = triple_pattern(people(spark, sf_dir), Pattern("?s", RDF_TYPE, DPA + "Region"))
    return path_closure(
        links.select(F.col("s").alias("source"), F.col("o").alias("target")), targets=ends.select(F.col("s").alias("node"))
    )


def components_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, nations and regions, with links back: each nation to its richest customer, each region to its first nation."""
    links = everything(spark, sf_dir).where(F.col("p").isin(DPA + "placedBy", DPA + "inNation", DPA + "inRegion"))
    graph = people(spark, sf_dir)
    rich = bgp_join(
        graph,
        [Pattern("?customer", DPA + "accountBalance", "?balance"), Pattern("?customer", DPA + "inNation", "?nation")],
    )
    led = rich.groupBy("nation").agg(F.max_by("customer", F.struct(number("balance"), "customer")).alias("target"))
    seats = bindings(graph, Pattern("?nation", DPA + "inRegion", "?region")).groupBy("region").agg(F.min("nation").alias("target"))
    edges = links.select(F.col("s").alias("source"), F.col("o").alias("target"))
    return path_components(edges.union(led.select("nation", "target")).union(seats.select("region", "target")))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, delete and clear, one after the other, on triples in flight."""
    graph = people(spark, sf_dir)
    renamed = triple_pattern(graph, Pattern("?s", DPA + "name", "?o", graph=graph_iri("nation"))).withColumn(
        "o", F.concat(F.lit("The "), F.col("o"))
    )
    grown = insert_data(graph, renamed.unionByName(graph.where(F.col("p") == RDF_TYPE)))
    poor = triple_pattern(graph, Pattern("?s", DPA + "accountBalance", "?o")).where(object_number() < 0)
    shrunk = delete_data(grown, poor)
    plain = delete_where(shrunk, Pattern("?s", DPA + "classifiedAs", "?o"))
    return clear_graph(plain, graph_iri("region"))


def stored_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kinds of change in a store; the graph of regions is emptied, that of nations grows."""
    path = scratch_path(spark, "store")
    publish_graphs(triples(spark, sf_dir, *PEOPLE, dealt=True), path)

    def change(touched: DataFrame) -> DataFrame:
        kept = clear_graph(touched, graph_iri("region"))
        return delete_where(kept, Pattern("?s", DPA + "accountBalance", "?o"))

    update_graphs(spark, path, [graph_iri("region"), graph_iri("customer")], change)
    nations = triples(spark, sf_dir, "nation")
    renamed = triple_pattern(nations, Pattern("?s", DPA + "name", "?o")).withColumn("o", F.concat(F.lit("The "), F.col("o")))
    insert_into(spark, path, nations.unionByName(renamed))
    return read_graphs(spark, path)


def bucketed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in buckets of subjects: published, added to twice with the same, and negative balances taken away."""
    graph = people(spark, sf_dir)
    largest = table(spark, sf_dir, "customer").count() * len(plan("customer").rules)
    store = BucketedStore(spark, scratch_path(spark, "buckets"), buckets_for(largest))
    store.publish(graph)
    names = triple_pattern(graph, Pattern("?s", DPA + "name", "?o", graph=graph_iri("nation")))
    renamed = names.withColumn("o", F.concat(F.lit("The "), F.col("o")))
    for _ in range(2):
        store.insert(renamed.unionByName(graph.where(F.col("p") == RDF_TYPE)))
    store.delete(triple_pattern(graph, Pattern("?s", DPA + "accountBalance", "?o")).where(object_number() < 0))
    return store.read()


def foreign_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of the graph of regions that also writes to that of nations, which keeps what it has."""
    path = scratch_path(spark, "store")
    publish_graphs(triples(spark, sf_dir, *PEOPLE, dealt=True), path)

    def change(touched: DataFrame) -> DataFrame:
        names = triple_pattern(touched, Pattern("?s", DPA + "name", "?o"))
        return insert_data(touched, names.withColumn("p", F.lit(DPA + "regionName")).withColumn("graph", F.lit(graph_iri("nation"))))

    update_graphs(spark, path, [graph_iri("region")], change)
    return read_graphs(spark, path)


def pattern_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers become worths, where the nation is known; all else stays."""
    path = scratch_path(spark, "store")
    publish_graphs(triples(spark, sf_dir, *PEOPLE, dealt=True), path)
    update_where(
        spark,
        path,
        graph_iri("customer"),
        where=[Pattern("?customer", DPA + "accountBalance", "?balance"), Pattern("?customer", DPA + "inNation", RESOURCE + "nation/3")],
        delete=[Pattern("?customer", DPA + "accountBalance", "?balance")],
        insert=[Pattern("?customer", DPA + "worth", "?balance"), Pattern("?customer", DPA + "ratedIn", RESOURCE + "nation/3")],
    )
    return read_graphs(spark, path)


def _rich(graph: DataFrame) -> DataFrame:
    found = bgp_join(
        graph,
        [Pattern("?customer", DPA + "accountBalance", "?balance"), Pattern("?customer", DPA + "inNation", "?nation")],
    )
    return found.where(number("balance") > 9000).drop("balance", "balance_kind")


def optional_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, their rich customers if any, and dear orders: of those customers, or of anyone where there are none."""
    graph = everything(spark, sf_dir)
    nations = bgp_join(graph, [Pattern("?nation", RDF_TYPE, DPA + "Nation"), Pattern("?nation", DPA + "name", "?name")])
    orders = bgp_join(
        graph,
        [
            Pattern("?order", DPA + "placedBy", "?customer"),
            Pattern("?customer", DPA + "inNation", "?nation"),
            Pattern("?order", DPA + "totalPrice", "?price"),
        ],
    ).where(number("price") > 400000)
    first = optional(nations, _rich(graph))
    return solutions(optional(first, orders, unbound=["customer"])).select("nation", "name", "customer", "order", "price")


def minus_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without the rich ones, and without all of nations that have no rich one."""
    graph = people(spark, sf_dir)
    homes = bgp_join(graph, [Pattern("?customer", DPA + "inNation", "?nation")])
    nations = bgp_join(graph, [Pattern("?nation", RDF_TYPE, DPA + "Nation")])
    return solutions(minus(homes, optional(nations, _rich(graph)), unbound=["customer"]))


def literal_or_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that are a nation, and not only its address as text."""
    customers = triples(spark, sf_dir, "customer")
    homes = triple_pattern(customers, Pattern("?s", DPA + "inNation", "?o"))
    as_text = F.pmod(F.substring_index("s", "/", -1).cast("long"), F.lit(2)) == 0
    notes = homes.withColumns(
        {
            "p": F.lit(DPA + "note"),
            "o_type": F.when(as_text, "literal").otherwise("uri"),
            "o_datatype": F.when(as_text, F.lit(XSD + "string")),
        }
    )
    noted = bgp_join(notes, [Pattern("?customer", DPA + "note", "?place")])
    return solutions(exists(noted, bgp_join(homes, [Pattern("?other", DPA + "inNation", "?place")])))


def typed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances summed by nation where a third of them are plain texts, which count as no number."""
    graph = people(spark, sf_dir)
    as_text = (F.col("p") == DPA + "accountBalance") & (F.pmod(F.substring_index("s", "/", -1).try_cast("long"), F.lit(3)) == 0)
    graph = graph.withColumn("o_datatype", F.when(as_text, F.lit(XSD + "string")).otherwise(F.col("o_datatype")))
    found = bgp_join(
        graph,
        [Pattern("?customer", DPA + "accountBalance", "?balance"), Pattern("?customer", DPA + "inNation", "?nation")],
    )
    amount = number("balance", "decimal(20,2)")
    return found.groupBy("nation").agg(
        F.count("*").alias("n"), F.count(amount).alias("n_numbers"), F.sum(amount).cast("double").alias("total")
    )


def stars_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four facts of each customer and two of its nation: two stars that meet in the nation."""
    found = bgp_star(
        whole(spark, sf_dir),
        [
            Pattern("?customer", RDF_TYPE, DPA + "Customer"),
            Pattern("?customer", DPA + "name", "?name"),
            Pattern("?customer", DPA + "accountBalance", "?balance"),
            Pattern("?customer", DPA + "inNation", "?nation"),
            Pattern("?nation", DPA + "name", "?nation_name"),
            Pattern("?nation", DPA + "inRegion", "?region"),
        ],
    )
    return solutions(found)


def stars_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and flags of orders, where one order has several of both: every choice is a solution, as in a join."""
    found = bgp_star(
        triples(spark, sf_dir, "lineitem", shape="rows"),
        [Pattern("?line", DPA + "part", "?part"), Pattern("?line", DPA + "returnFlag", "?flag")],
    )
    return found.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("part").alias("n_parts"))


def sets_of_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = characteristic_sets(triples(spark, sf_dir, *ALL_TABLES, "lineitem", shape="rows"))
    text = lambda name: F.array_join(F.transform(name, lambda n: n.cast("string")), " ").alias(name)
    return found.select(F.array_join("predicates", " ").alias("predicates"), "subjects", text("triples"), text("most"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_counts(whole(spark, sf_dir))


_P = with_triples(*PEOPLE)
_A = with_triples(*ALL_TABLES)
_CN = f"'{RESOURCE}customer/' || c_custkey AS customer, '{RESOURCE}nation/' || c_nationkey AS nation FROM customer"

QUERIES = {
    "list_graphs": Query(lambda s, d: list_graphs(whole(s, d)), _A + "SELECT DISTINCT graph FROM t ORDER BY graph"),
    "graph_sample": Query(
        lambda s, d: graph_sample(everything(s, d), graph_iri("customer")),
        with_triples("customer") + "SELECT * FROM t ORDER BY s, p, o LIMIT 100",
    ),
    "bindings_rows": Query(bindings_query, _RESULT_ROWS),
    "bindings_variant": Query(
        bindings_cells,
        f"WITH r AS ({_RESULT_ROWS}) " + " UNION ALL ".join(
            f"SELECT result_id, row_index, '{name}' AS variable, {name} AS value, {name}_type AS type FROM r WHERE {name} IS NOT NULL" for name in "spo"
        ),
    ),
    "complete_triples": Query(
        complete, f"SELECT s, p, o, o_type FROM ({_RESULT_ROWS}) WHERE o IS NOT NULL"
    ),
    "table_view": Query(shown, f"SELECT s, p, COALESCE(o, '') AS o FROM ({_RESULT_ROWS})"),
    "graph_nodes": Query(lambda s, d: graph_nodes(triples(s, d, "customer")), _NODES_SQL),
    "graph_edges": Query(
        lambda s, d: graph_edges(triples(s, d, "customer")),
        f"{_DRAWN} SELECT 'edge-' || place AS id, s AS source, o AS target, p AS predicate, {_LABEL.format('p')} AS label FROM d",
    ),
    "graph_counts": Query(sizes, _A + "SELECT graph, count(*) AS triple_count FROM t GROUP BY graph"),
    "triple_pattern": Query(
        lambda s, d: triple_pattern(
            everything(s, d), Pattern("?s", DPA + "inNation", RESOURCE + "nation/7", graph=graph_iri("customer"))
        ),
        _A + f"SELECT * FROM t WHERE p = '{DPA}inNation' AND o = '{RESOURCE}nation/7'",
    ),
    "bgp_join": Query(
        paths_to_region,
        "SELECT r_name AS region_name, count(*) AS customer_count FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "bgp_optional": Query(
        with_rich_customers,
        f"SELECT n_name AS name, '{RESOURCE}customer/' || c_custkey AS customer, CAST(c_acctbal AS VARCHAR) AS balance "
        "FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900",
    ),
    "bgp_not_exists": Query(
        without_dear_orders,
        f"SELECT {_CN} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "bgp_exists": Query(
        with_open_orders, f"SELECT {_CN} WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
    ),
    "bgp_minus": Query(
        minus_open, f"SELECT {_CN} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
    ),
    "bgp_union": Query(
        union_of_names,
        f"SELECT '{RESOURCE}nation/' || n_nationkey AS it, '{RESOURCE}region/' || n_regionkey AS region, n_name AS name FROM nation "
        f"UNION ALL SELECT '{RESOURCE}region/' || r_regionkey, NULL, r_name FROM region",
    ),
    "bgp_top_k": Query(
        dearest_orders,
        f"SELECT '{RESOURCE}orders/' || o_orderkey AS \"order\", CAST(o_totalprice AS VARCHAR) AS price, "
        f"'{RESOURCE}customer/' || o_custkey AS customer FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 10 OFFSET 5",
    ),
    "bgp_aggregate": Query(
        balance_by_nation,
        "SELECT n_name AS name, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(20,2))) AS DOUBLE) AS total "
        "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING sum(CAST(c_acctbal AS DECIMAL(20,2))) > 0",
    ),
    "bgp_construct": Query(
        region_links,
        f"""WITH j AS (SELECT '{RESOURCE}customer/' || c_custkey AS c, '{RESOURCE}region/' || n_regionkey AS r, c_name
                       FROM customer JOIN nation ON c_nationkey = n_nationkey),
        x AS (SELECT c AS s, '{DPA}livesIn' AS p, r AS o, 'uri' AS o_type, CAST(NULL AS VARCHAR) AS o_datatype FROM j
              UNION SELECT r, '{DPA}knows', c_name, 'literal', '{XSD}string' FROM j
              UNION SELECT r, '{DPA}kind', 'inhabited', 'literal', '{XSD}string' FROM j)
        SELECT '{GRAPH}derived' AS graph, *, CAST(NULL AS VARCHAR) AS o_lang FROM x""",
    ),
    "describe_node": Query(
        described, _A + f"SELECT DISTINCT * FROM t WHERE s = '{RESOURCE}nation/0' OR o = '{RESOURCE}nation/0'"
    ),
    "path_closure": Query(
        closure,
        _LINKS.replace("WITH t", "WITH RECURSIVE t", 1)
        + ", w AS (SELECT s AS start, o AS node FROM l UNION SELECT w.start, l.o FROM w JOIN l ON w.node = l.s) SELECT start, node FROM w",
    ),
    "path_closure_star": Query(
        closure_from_nations,
        f"""SELECT '{RESOURCE}nation/' || n_nationkey AS start, '{RESOURCE}nation/' || n_nationkey AS node FROM nation
        UNION SELECT '{RESOURCE}nation/' || c_nationkey, '{RESOURCE}customer/' || c_custkey FROM customer
        UNION SELECT '{RESOURCE}nation/' || c_nationkey, '{RESOURCE}orders/' || o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey""",
    ),
    "path_closure_to": Query(
        closure_to_regions,
        f"""WITH n AS (SELECT '{RESOURCE}region/' || n_regionkey AS node, * FROM nation),
        c AS (SELECT * FROM n JOIN customer ON c_nationkey = n_nationkey), o AS (SELECT * FROM c JOIN orders ON o_custkey = c_custkey)
        SELECT '{RESOURCE}nation/' || n_nationkey AS start, node FROM n UNION ALL SELECT '{RESOURCE}customer/' || c_custkey, node FROM c
        UNION ALL SELECT '{RESOURCE}orders/' || o_orderkey, node FROM o""",
    ),
    "path_components": Query(
        components_of_links,
        _LINKS.replace("WITH t", "WITH RECURSIVE t", 1)
        + f""", k AS (SELECT s, o FROM l
          UNION SELECT '{RESOURCE}nation/' || c_nationkey, arg_max('{RESOURCE}customer/' || c_custkey, (c_acctbal, '{RESOURCE}customer/' || c_custkey))
            FROM customer GROUP BY c_nationkey
          UNION SELECT '{RESOURCE}region/' || n_regionkey, min('{RESOURCE}nation/' || n_nationkey) FROM nation GROUP BY n_regionkey),
        w AS (SELECT s AS a, o AS b FROM k UNION SELECT w.a, k.o FROM w JOIN k ON w.b = k.s),
        nodes AS (SELECT a AS node FROM w UNION SELECT b FROM w),
        c AS (SELECT node, least(node, coalesce(min(x.b), node)) AS component FROM nodes
              LEFT JOIN (SELECT w.a, w.b FROM w JOIN w v ON v.a = w.b AND v.b = w.a) x ON x.a = node GROUP BY node),
        z AS (SELECT component, count(*) AS members FROM c GROUP BY component)
        SELECT DISTINCT one.component, p.members, two.component AS reached, q.members AS reached_members FROM w
        JOIN c one ON one.node = a JOIN c two ON two.node = b JOIN z p ON p.component = one.component JOIN z q ON q.component = two.component""",
    ),
    "graph_update": Query(
        updates,
        _P
        + f""", g AS (SELECT DISTINCT * FROM (SELECT * FROM t UNION ALL
               SELECT * REPLACE ('The ' || o AS o) FROM t WHERE p = '{DPA}name' AND graph = '{GRAPH}nation'))
        SELECT * FROM g WHERE graph <> '{GRAPH}region' AND p <> '{DPA}classifiedAs'
          AND NOT (p = '{DPA}accountBalance' AND TRY_CAST(o AS DOUBLE) < 0)""",
    ),
    "graph_update_stored": Query(
        stored_updates,
        _P + f"SELECT * FROM t WHERE graph <> '{GRAPH}region' AND p <> '{DPA}accountBalance' UNION ALL "
        f"SELECT * REPLACE ('The ' || o AS o) FROM t WHERE graph = '{GRAPH}nation' AND p = '{DPA}name'",
    ),
    "graph_update_bucketed": Query(
        bucketed_updates,
        _P + f"SELECT * FROM t WHERE p <> '{DPA}accountBalance' OR CAST(o AS DOUBLE) >= 0 UNION ALL "
        f"SELECT * REPLACE ('The ' || o AS o) FROM t WHERE graph = '{GRAPH}nation' AND p = '{DPA}name'",
    ),
    "graph_update_foreign": Query(
        foreign_updates,
        _P + f"SELECT * FROM t UNION ALL SELECT * REPLACE ('{GRAPH}nation' AS graph, '{DPA}regionName' AS p) "
        f"FROM t WHERE graph = '{GRAPH}region' AND p = '{DPA}name'",
    ),
    "graph_update_where": Query(
        pattern_updates,
        _P
        + f""", c AS (SELECT s FROM t WHERE p = '{DPA}inNation' AND o = '{RESOURCE}nation/3')
        SELECT * REPLACE (CASE WHEN p = '{DPA}accountBalance' AND s IN (SELECT s FROM c) THEN '{DPA}worth' ELSE p END AS p) FROM t
        UNION ALL SELECT * REPLACE ('{DPA}ratedIn' AS p) FROM t WHERE p = '{DPA}inNation' AND o = '{RESOURCE}nation/3'""",
    ),
    "bgp_optional_chain": Query(
        optional_chain,
        f"""WITH rich AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000),
        dear AS (SELECT o_orderkey, o_totalprice, c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000),
        one AS (SELECT n_nationkey, n_name, c_custkey FROM nation LEFT JOIN rich ON c_nationkey = n_nationkey)
        SELECT '{RESOURCE}nation/' || n_nationkey AS nation, n_name AS name,
          '{RESOURCE}customer/' || coalesce(one.c_custkey, dear.c_custkey) AS customer,
          '{RESOURCE}orders/' || o_orderkey AS "order", CAST(o_totalprice AS VARCHAR) AS price
        FROM one LEFT JOIN dear ON c_nationkey = n_nationkey AND (one.c_custkey IS NULL OR one.c_custkey = dear.c_custkey)""",
    ),
    "bgp_minus_unbound": Query(
        minus_unbound,
        f"SELECT {_CN} WHERE c_acctbal <= 9000 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)",
    ),
    "bgp_literal_vs_iri": Query(
        literal_or_iri,
        f"SELECT '{RESOURCE}customer/' || c_custkey AS customer, '{RESOURCE}nation/' || c_nationkey AS place FROM customer WHERE c_custkey % 2 = 1",
    ),
    "bgp_sum_typed": Query(
        typed_sum,
        f"""SELECT '{RESOURCE}nation/' || c_nationkey AS nation, count(*) AS n, count(*) FILTER (c_custkey % 3 <> 0) AS n_numbers,
        CAST(sum(CAST(c_acctbal AS DECIMAL(20,2))) FILTER (c_custkey % 3 <> 0) AS DOUBLE) AS total FROM customer GROUP BY c_nationkey""",
    ),
    "bgp_star": Query(
        stars_of_customers,
        f"SELECT {_CN.removesuffix(' FROM customer')}, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance, n_name AS nation_name, "
        f"'{RESOURCE}region/' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "bgp_star_bag": Query(
        stars_of_lines,
        "SELECT b.l_returnflag AS flag, count(*) AS n, count(DISTINCT a.l_partkey) AS n_parts "
        "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY b.l_returnflag",
    ),
    "characteristic_sets": Query(
        sets_of_predicates,
        with_triples(*ALL_TABLES, "lineitem")
        + """, k AS (SELECT s, p, count(*) AS n FROM t GROUP BY s, p),
        o AS (SELECT s, string_agg(p, ' ' ORDER BY p) AS predicates FROM k GROUP BY s),
        x AS (SELECT predicates, p, count(*) AS subjects, sum(n) AS triples, max(n) AS most FROM k JOIN o USING (s) GROUP BY predicates, p)
        SELECT predicates, max(subjects) AS subjects, string_agg(CAST(CAST(triples AS BIGINT) AS VARCHAR), ' ' ORDER BY p) AS triples,
          string_agg(CAST(most AS VARCHAR), ' ' ORDER BY p) AS most FROM x GROUP BY predicates""",
    ),
    "predicate_stats": Query(
        lambda s, d: predicate_stats(whole(s, d)),
        _A + "SELECT p, count(*) AS triple_count, count(*) FILTER (o_type = 'uri') AS resource_count FROM t GROUP BY p",
    ),
    "node_degrees": Query(
        lambda s, d: node_degrees(whole(s, d)),
        _A + "SELECT node, CAST(sum(a) AS BIGINT) AS out_degree, CAST(sum(b) AS BIGINT) AS in_degree FROM "
        "(SELECT s AS node, 1 AS a, 0 AS b FROM t UNION ALL SELECT o, 0, 1 FROM t WHERE o_type <> 'literal') GROUP BY node",
    ),
    "class_counts": Query(
        lambda s, d: class_counts(everything(s, d)),
        _A + f"SELECT o AS class_iri, count(*) AS instance_count FROM t WHERE p = '{RDF_TYPE}' GROUP BY o",
    ),
}
