"""The life of mappings: registered, checked, activated, published and projected.

State is kept in three tables below one folder: the event log of mappings, the
log of projection runs, and the published graphs. Events are only ever
appended; every state is derived from them by a Spark job. Parquet gives no
transactions, so writers of one workspace must take turns.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .model import EVENT_SCHEMA, JOB_SCHEMA, MappingSpec, payload_json, specs_frame
from .operators import projection as projecting
from .operators import registry
from .operators.materialize import materialize_many
from .operators.render import render_rml
from .operators.rml_rules import document_triples, plan_batches, rejected_documents
from .operators.turtle import (
    bad_columns,
    corpus_of,
    mapping_projections,
    ontology_classes,
    ontology_summary,
    term_lookup,
    ttl_prefixes,
)
from .operators.validate import projection_errors, raise_on_error, validate_mappings, validation_summary
from .plans import MappingPlan
from .session import remove_path, scratch_path
from .sources.catalog import catalog_snapshot
from .sources.graphs import publish_graphs, read_graphs
from .vocab import MAPPINGS_GRAPH, ONTOLOGY_ID, ONTOLOGY_LABEL, PROFILES, PROJECTION_TARGET


class Workspace:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        ontology: DataFrame,
        schemes: DataFrame,
        catalog: str | None = None,
        table_format: str = "delta",
        table_location: str | None = None,
    ):
        """``ontology`` is a corpus of Turtle documents, ``schemes`` the registry of identifier schemes.

        ``catalog``, ``table_format`` and ``table_location`` say where projected
        tables go if not where their names and documents put them.
        """
        self.spark = spark
        self.root = root.rstrip("/")
        self.ontology = ontology
        self.schemes = schemes
        self.catalog = catalog
        self.table_format = table_format
        self.table_location = table_location

    # -- ontology -------------------------------------------------------------------------------

    def classes(self) -> DataFrame:
        return ontology_classes(self.ontology)

    def summary(self) -> dict[str, Any]:
        counts = ontology_summary(self.classes(), self.schemes).first().asDict()
        return {"id": ONTOLOGY_ID, "label": ONTOLOGY_LABEL, "profiles": list(PROFILES), **counts}

    def prefixes(self) -> DataFrame:
        return ttl_prefixes(self.ontology)

    def term(self, term: str) -> dict[str, Any]:
        asked = self.spark.createDataFrame([(term,)], "term string")
        row = term_lookup(asked, self.classes()).first()
        if row.iri is None:
            raise ValueError(f"Unknown ontology term: {term}")
        return {"id": term, "iri": row.iri, "label": row.label, "comment": row.comment}

    # -- the event log --------------------------------------------------------------------------

    def events(self) -> DataFrame:
        return self._table("events", EVENT_SCHEMA)

    def jobs(self) -> DataFrame:
        return self._table("jobs", JOB_SCHEMA)

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _next_seq(self) -> int:
        return (self.events().agg(F.max("seq").alias("n")).first().n or 0) + 1

    def _append(self, events: DataFrame) -> None:
        events.write.mode("append").parquet(f"{self.root}/events")

    def _note(self, mapping_id: str, op: str, **given: str | None) -> None:
        row = {
            "mapping_id": mapping_id,
            "seq": self._next_seq(),
            "ts": datetime.datetime.now(datetime.UTC),
            "op": op,
            **given,
        }
        self._append(self.spark.createDataFrame([row], EVENT_SCHEMA))

    # -- records --------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        return registry.records_of(self._state())

    def _state(self) -> DataFrame:
        """The newest snapshot and what has happened since; without one, the whole log."""
        mark = self._mark()
        if mark is None:
            return registry.advance(None, self.events())
        held = self.spark.read.parquet(f"{self.root}/snapshots").where(F.col("mark") == mark).drop("mark")
        return registry.advance(held, self.events().where(F.col("seq") > mark))

    def _mark(self) -> int | None:
        """The number up to which the newest snapshot holds all events."""
        try:
            snapshots = self.spark.read.parquet(f"{self.root}/snapshots")
        except AnalysisException:
            return None
        return snapshots.agg(F.max("mark").alias("mark")).first().mark

    def snapshot(self) -> int:
        """Store the state of all mappings, so that later reads look at newer events only; returns the last number it holds.

        A snapshot is a folder of its own and the log stays as it is: a failed one is not seen, and an old one can go.
        """
        mark = self._next_seq() - 1
        if mark and mark != self._mark():
            self._state().withColumn("mark", F.lit(mark).cast("long")).write.mode("append").partitionBy("mark").parquet(f"{self.root}/snapshots")
        return mark

    def list(self, dataset: str | None = None) -> DataFrame:
        found = self.records()
        if dataset:
            found = registry.mappings_by_dataset(found, dataset)
        return registry.list_mappings(found)

    def _require(self, mapping_id: str) -> Any:
        row = self.records().where(F.col("id") == mapping_id).first()
        if row is None:
            raise KeyError(mapping_id)
        return row

    def rml(self, mapping_id: str) -> str:
        return self._require(mapping_id).rml

    def get(self, mapping_id: str) -> dict[str, Any]:
        record = self._require(mapping_id).asDict()
        return {**record, "validation": self._summary_of(mapping_id, record["rml"])}

    def _corpus_of_text(self, mapping_id: str, rml: str) -> DataFrame:
        return corpus_of(self.spark.createDataFrame([(mapping_id, rml)], "mapping_id string, rml string"))

    def _summary_of(self, mapping_id: str, rml: str) -> dict[str, Any]:
        corpus = self._corpus_of_text(mapping_id, rml)
        raise_on_error(bad_columns(corpus))
        row = validation_summary(corpus, self.classes()).first()
        if row is None:
            return {"valid": True, "projection_count": 0, "warnings": []}
        return {"valid": row.valid, "projection_count": row.projection_count, "warnings": list(row.warnings)}

    def register(self, spec: MappingSpec) -> dict[str, Any]:
        """Register one declaration. Raises ``ValueError`` if it, or its document, has errors."""
        specs = specs_frame(self.spark, [spec])
        raise_on_error(validate_mappings(specs, self.schemes))
        rml = render_rml(specs, self.schemes).first().rml
        return self._create("simple", spec.ontology or ONTOLOGY_ID, spec.profile or PROFILES[0], rml, payload_json(spec))

    def register_batch(self, specs: DataFrame, batch: str) -> DataFrame:
        """Register a table of declarations in one job; unsound ones are left out."""
        now = F.lit(datetime.datetime.now(datetime.UTC))
        first = self._next_seq()
        made = registry.register_batch(specs, self.schemes, at=now, seq=F.lit(first), batch=batch)
        self._append(made)
        return made

    def register_document(self, ttl: str, ontology: str = "", profile: str = "") -> dict[str, Any]:
        """Register a hand-written document; it is not bound to the known ontology and profiles."""
        if not ttl.strip():
            raise ValueError("ttl is required")
        return self._create("rml", ontology or ONTOLOGY_ID, profile or "rml", ttl, None)

    def _create(self, source: str, ontology: str, profile: str, rml: str, payload: str | None) -> dict[str, Any]:
        mapping_id = f"map-{uuid.uuid4().hex[:12]}"
        self._summary_of(mapping_id, rml)
        self._note(
            mapping_id,
            registry.REGISTER,
            source=source,
            ontology=ontology,
            profile=profile,
            status="draft",
            payload=payload,
            rml=rml,
        )
        return self.get(mapping_id)

    def replace_rml(self, mapping_id: str, ttl: str) -> dict[str, Any]:
        """Replace a document. It is stored first, so a broken one is kept and then reported."""
        self._require(mapping_id)
        self._note(mapping_id, registry.UPDATE, rml=ttl)
        return self.get(mapping_id)

    def delete(self, mapping_id: str) -> None:
        """Delete a record; none of that id is fine. The published graph stays as it is."""
        self._note(mapping_id, registry.DELETE)

    def validate(self, mapping_id: str) -> dict[str, Any]:
        return self._summary_of(mapping_id, self.rml(mapping_id))

    # -- lifecycle ------------------------------------------------------------------------------

    def activate(self, mapping_id: str) -> dict[str, Any]:
        return self._set_status(mapping_id, registry.ACTIVATE)

    def deprecate(self, mapping_id: str) -> dict[str, Any]:
        return self._set_status(mapping_id, registry.DEPRECATE)

    def _set_status(self, mapping_id: str, op: str) -> dict[str, Any]:
        self._require(mapping_id)
        self._note(mapping_id, op)
        self.publish()
        return self._require(mapping_id).asDict()

    def rejected(self) -> DataFrame:
        """``(mapping_id, problem)`` of active documents that cannot be published as a whole."""
        return rejected_documents(corpus_of(registry.documents_of(registry.active_mappings(self.records()))))

    def publish(self, clear_if_empty: bool = False, skip_rejected: bool = False) -> None:
        """Replace the mappings graph by the documents of all active mappings.

        Without any, the graph stays as it was, unless ``clear_if_empty``.
        Raises ``ValueError`` if a document cannot be turned into triples as a
        whole, unless told to go on without such documents.
        """
        active = registry.documents_of(registry.active_mappings(self.records()))
        rejected = self.rejected()
        if skip_rejected:
            active = active.join(rejected.select(F.col("mapping_id")).distinct(), "mapping_id", "left_anti")
        elif bad := rejected.limit(5).collect():
            raise ValueError("; ".join(f"{row.mapping_id}: {row.problem}" for row in bad))
        triples = document_triples(corpus_of(active), MAPPINGS_GRAPH)
        publish_graphs(triples, f"{self.root}/graphs", clear_if_empty=[MAPPINGS_GRAPH] if clear_if_empty else None)

    def materialize(self, tables: Callable[[str], DataFrame], graph: Callable[[str], str], batch: int = 200) -> None:
        """Run all active mappings: the rows they describe as triples, published graph by graph.

        ``tables`` gives the table of a source URI, ``graph`` names the graph of
        a mapping id. Mappings are planned and run ``batch`` at a time, in the
        order of their sources, and those of one source share a scan, into a
        staged copy, from which each graph is published once, as a set: mappings
        may share graphs, and a failing one leaves the old graphs in place.
        """
        staged = scratch_path(self.spark, "materialized")
        corpus = corpus_of(registry.documents_of(registry.active_mappings(self.records())))
        sources_seen = False
        for plans in plan_batches(corpus, batch, by_source=True):
            jobs: dict[str, list[tuple[MappingPlan, str]]] = {}
            for mapping_id, uri, plan in plans:
                if uri is not None:
                    jobs.setdefault(uri, []).append((plan, graph(mapping_id)))
            sources_seen |= bool(jobs)
            if jobs:
                made = reduce(DataFrame.unionByName, [materialize_many(tables(uri), of_source) for uri, of_source in jobs.items()])
                made.write.mode("append").partitionBy("graph").parquet(staged)
        if sources_seen:
            publish_graphs(read_graphs(self.spark, staged), f"{self.root}/graphs")
            remove_path(self.spark, staged)

    def graph(self, name: str = MAPPINGS_GRAPH) -> DataFrame:
        return read_graphs(self.spark, f"{self.root}/graphs", name)

    # -- projection -----------------------------------------------------------------------------

    def project(self, ids: Iterable[str] | None = None, strict: bool = True) -> dict[str, Any]:
        """Bring the catalog in line with the named mappings, or with all whatever their status.

        Tables the catalog lacks are created, those it has are checked. A run
        that fails is not logged.
        """
        records = self.records()
        covered = records.select("id")
        if ids is not None:
            covered = self.spark.createDataFrame([(name,) for name in ids], "id string").distinct()
            if missing := covered.join(records.select("id"), "id", "left_anti").limit(1).collect():
                raise KeyError(missing[0].id)
        corpus = corpus_of(registry.rml_for_ids(records, covered))
        raise_on_error(bad_columns(corpus))
        projections = mapping_projections(corpus)
        raise_on_error(projection_errors(projections))
        wanted_tables = projecting.desired_tables(projecting.projection_plan(projections, self.classes()))
        # Two mappings of one table must agree before the first statement runs.
        projecting.raise_on_drift(projecting.name_conflicts(wanted_tables))
        wanted_tables = projecting.first_of_each_name(wanted_tables)
        names = (row.full_name for row in wanted_tables.select("full_name").distinct().toLocalIterator())
        present = catalog_snapshot(self.spark, names, self.catalog)
        drift = projecting.property_drift(wanted_tables, present, strict=strict)
        projecting.raise_on_drift(drift)
        made = projecting.apply_projection(
            self.spark,
            projecting.create_actions(wanted_tables, present),
            self.table_format,
            self.catalog,
            self.table_location,
        )
        job_id = f"job-{uuid.uuid4().hex[:12]}"
        now = F.lit(datetime.datetime.now(datetime.UTC))
        # A row without mapping stands for the job itself, so that one over nothing is logged too.
        header = self.spark.createDataFrame([(None,)], "id string")
        log = registry.projection_jobs(covered.union(header), F.lit(job_id), now, PROJECTION_TARGET)
        log.write.mode("append").parquet(f"{self.root}/jobs")
        return {"id": job_id, "status": "succeeded", "target": PROJECTION_TARGET, "created": made}

    def check(self, ids: Iterable[str]) -> DataFrame:
        """Catalog entries of the named mappings whose class or location is not what their documents say.

        Locations are left out where the workspace puts tables elsewhere.
        """
        covered = self.spark.createDataFrame([(name,) for name in ids], "id string").distinct()
        projections = mapping_projections(corpus_of(registry.rml_for_ids(self.records(), covered)))
        expected = projecting.projection_plan(projections, self.classes())
        names = (row.full_name for row in expected.select("full_name").distinct().toLocalIterator())
        found = projecting.semantic_check(expected, catalog_snapshot(self.spark, names, self.catalog))
        return found if self.table_location is None else found.where(F.col("fact") != "storage_location")

    def job_mappings(self, job_id: str) -> DataFrame:
        """``(mapping_id)`` of the mappings that a projection run covered."""
        return self.jobs().where((F.col("job_id") == job_id) & F.col("mapping_id").isNotNull()).select("mapping_id")

    def job(self, job_id: str) -> dict[str, Any]:
        row = registry.job_overview(self.jobs().where(F.col("job_id") == job_id)).first()
        if row is None:
            raise KeyError(job_id)
        return row.asDict()
