"""Times the headline queries: one warm-up, three timed runs, median, all columns computed.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.materialize import distinct_triples, materialize, materialize_distinct
from tripleloom.operators.registry import current_status
from tripleloom.operators.turtle import corpus_of, mapping_projections, ttl_statements
from tripleloom.session import build_session, scratch_path
from tripleloom.sources import publish_graphs, read_graphs
from tripleloom.vocab import DPA
from tripleloom.workloads import ALL, documents, lifecycle
from tripleloom.workloads.data import RESOURCE, graph_iri, plan, table, triples

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        spark_sql_shuffle_partitions=CPUS,
        spark_ui_enabled="false",
        spark_driver_memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    orders = table(spark, SF_DIR, "orders")
    lineitem = table(spark, SF_DIR, "lineitem")

    store = scratch_path(spark, "bench-graphs")
    publish_graphs(triples(spark, SF_DIR, "region", "nation", "customer", "orders", shape="rows"), store)
    rendered = scratch_path(spark, "bench-documents")
    documents.render(spark, SF_DIR).repartition(int(CPUS)).write.parquet(rendered)

    def made(shape: str, **bound: str) -> DataFrame:
        return materialize(orders, plan("orders"), graph_iri("orders"), shape=shape, **bound)

    def corpus() -> DataFrame:
        return corpus_of(spark.read.parquet(rendered))

    queries = {
        "materialize_mapping": lambda: made("rows"),
        "materialize_branches": lambda: made("branches"),
        "predicate_bound": lambda: made("branches").where(F.col("p") == DPA + "placedBy"),
        "subject_bound": lambda: made("branches", subject=RESOURCE + "orders/4711"),
        "distinct_compact": lambda: materialize_distinct(lineitem, plan("lineitem"), graph_iri("lineitem")),
        "distinct_plain": lambda: distinct_triples(materialize(lineitem, plan("lineitem"), graph_iri("lineitem"))),
        "bgp_join": lambda: ALL["bgp_join"].run(spark, SF_DIR),
        "bgp_star": lambda: ALL["bgp_star"].run(spark, SF_DIR),
        "materialize_many": lambda: ALL["materialize_many"].run(spark, SF_DIR),
        "registry_snapshot": lambda: ALL["registry_snapshot"].run(spark, SF_DIR),
        "bgp_aggregate": lambda: ALL["bgp_aggregate"].run(spark, SF_DIR),
        "predicate_stats": lambda: ALL["predicate_stats"].run(spark, SF_DIR),
        "graph_scan": lambda: read_graphs(spark, store, graph_iri("customer")),
        "path_closure": lambda: ALL["path_closure"].run(spark, SF_DIR),
        "dangling_refs": lambda: ALL["dangling_refs"].run(spark, SF_DIR),
        "render_rml": lambda: documents.render(spark, SF_DIR),
        "ttl_statements": lambda: ttl_statements(corpus()),
        "mapping_projections": lambda: mapping_projections(corpus()),
        "current_status": lambda: current_status(lifecycle.events(spark, SF_DIR)),
        "dataset_profile": lambda: ALL["dataset_profile"].run(spark, SF_DIR),
        "graph_update": lambda: ALL["graph_update"].run(spark, SF_DIR),
        "iri_safe": lambda: ALL["iri_safe"].run(spark, SF_DIR),
        "monte_carlo_pi": lambda: ALL["monte_carlo_pi"].run(spark, SF_DIR),
    }
    chosen = sys.argv[1:] or list(queries)
    timings: dict[str, float] = {}
    for name in chosen:
        taken = []
        for run in range(RUNS + 1):
            begun = time.perf_counter()
            queries[name]().write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - begun)
        timings[name] = round(statistics.median(taken), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
