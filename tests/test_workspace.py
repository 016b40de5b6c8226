"""The life of a mapping, from declaration to catalog."""

import pytest
from fixtures import GOLDEN, ONTOLOGY, SCHEMES, D, declare
from pyspark.sql import functions as F

from tripleloom import Mapper, Workspace, schemes_frame, specs_frame
from tripleloom.model import EVENT_SCHEMA
from tripleloom.operators.registry import advance, current_records, records_of, register_batch
from tripleloom.vocab import MAPPINGS_GRAPH, RDF_TYPE, RR

EXPERT = """@prefix rr: <http://www.w3.org/ns/r2rml#> .
<e> a rr:TriplesMap ; rr:subjectMap [ rr:template "http://x/{id}" ] ."""


@pytest.fixture
def workspace(spark, tmp_path):
    ontology = spark.createDataFrame([("o", 0, ONTOLOGY)], "doc_id string, doc_order bigint, text string")
    return Workspace(
        spark,
        str(tmp_path / "home"),
        ontology,
        schemes_frame(spark, SCHEMES),
        catalog="spark_catalog",
        table_format="parquet",
        table_location=str(tmp_path / "tables"),
    )


@pytest.fixture
def clean_catalog(spark):
    yield
    spark.sql("DROP TABLE IF EXISTS spark_catalog.default.gauges")


def test_register_and_project(spark, workspace, clean_catalog):
    done = declare(workspace).register_and_project()
    mapping_id = done["mapping"]["id"]
    assert done["mapping"]["status"] == "active"
    assert done["validation"] == {"valid": True, "projection_count": 1, "warnings": []}
    assert workspace.rml(mapping_id) == GOLDEN
    assert done["projection"]["created"] == ["spark_catalog.default.gauges"]
    assert workspace.job(done["projection"]["id"])["mapping_count"] == 1

    table = spark.table("spark_catalog.default.gauges")
    assert [(f.name, f.dataType.simpleString()) for f in table.schema.fields] == [
        ("code", "string"), ("river", "string"), ("depth", "double"), ("basin", "int"),
    ]
    properties = {
        row.key: row.value for row in spark.sql("SHOW TBLPROPERTIES spark_catalog.default.gauges").collect()
    }
    assert properties["semantic.class"] == D + "Gauge" and properties["semantic.label"] == "River gauge"

    # The published graph can be asked like any other.
    graph = workspace.graph()
    assert graph.where((F.col("p") == RDF_TYPE) & (F.col("o") == RR + "TriplesMap")).count() == 1
    assert graph.where(F.col("p") == RR + "predicateObjectMap").count() == 4
    assert graph.where((F.col("p") == RR + "predicate") & (F.col("o") == D + "depth")).count() == 1
    assert graph.select("graph").distinct().collect() == [(MAPPINGS_GRAPH,)]

    # A second run only checks; changed properties stop it, and no job is logged then.
    assert workspace.project([mapping_id])["created"] == []
    jobs = workspace.jobs().count()
    spark.sql("ALTER TABLE spark_catalog.default.gauges SET TBLPROPERTIES ('semantic.label' = 'X')")
    with pytest.raises(RuntimeError, match="semantic.label"):
        workspace.project()
    assert workspace.jobs().count() == jobs
    assert workspace.project(strict=False)["status"] == "succeeded"


def test_lifecycle(workspace):
    first = Mapper(workspace).register_rml(EXPERT)
    second = declare(workspace).register()
    assert (first["source"], first["status"], first["payload"]) == ("rml", "draft", None)
    assert first["validation"]["projection_count"] == 0
    assert [row.id for row in workspace.list().collect()] == sorted([first["id"], second["id"]])
    assert [row.id for row in workspace.list("unity.default.gauges").collect()] == [second["id"]]

    Mapper(workspace).activate_mapping(first)
    before = workspace.graph().count()
    assert before > 0
    # Without active mappings nothing is published, and the old graph stays.
    workspace.deprecate(first["id"])
    assert workspace.graph().count() == before
    workspace.publish(clear_if_empty=True)
    workspace.activate(second["id"])
    assert workspace.graph().where(F.col("o") == "http://x/{id}").count() == 0

    # A broken document is kept although it is reported.
    broken = '<m> dpa:unityCatalogObject "a.b.c" ; rr:class <C> ; dpa:unityCatalogColumn "lonely" .'
    with pytest.raises(ValueError, match="lonely"):
        workspace.replace_rml(second["id"], broken)
    record = workspace.records().where(F.col("id") == second["id"]).first()
    assert (record.rml, record.source, record.status) == (broken, "rml", "active")
    with pytest.raises(ValueError):
        workspace.project()

    workspace.delete(second["id"])
    workspace.delete("never-there")
    with pytest.raises(KeyError):
        workspace.get(second["id"])
    with pytest.raises(KeyError):
        workspace.activate(second["id"])
    with pytest.raises(KeyError):
        workspace.job("none")
    with pytest.raises(ValueError, match="ttl is required"):
        workspace.register_document(" \n")
    with pytest.raises(ValueError, match="Unknown ontology"):
        Mapper(workspace, ontology="x").dataset("a.b.c").subject_identifier(column="i", scheme="hydro:gauge").register()


def test_unknown_class_is_a_warning(workspace):
    spec = Mapper(workspace).dataset("a.b.c").row_subject(rdf_class="x:Y").subject_identifier(column="i", scheme="hydro:gauge")
    assert spec.register()["validation"]["warnings"] == [f"Class not found in ontology: {D}x/Y"]


def test_ontology(workspace):
    assert workspace.summary()["class_count"] == 3 and workspace.summary()["identifier_scheme_count"] == 2
    assert workspace.term("Gauge")["iri"] == D + "Gauge"
    assert {row.prefix for row in workspace.prefixes().collect()} == {"dpa", "owl", "rdfs"}
    with pytest.raises(ValueError):
        workspace.term("Nothing")


def test_batch_ids_are_stable(spark):
    specs = specs_frame(spark, [declare().spec()])
    make = lambda batch: register_batch(specs, schemes_frame(spark, SCHEMES), F.lit("2024-01-01").cast("timestamp"), batch=batch)
    first, again, other = (make(batch).first().mapping_id for batch in ("a", "a", "b"))
    assert first == again != other and len(first) == 36


def test_states(spark):
    def event(mapping_id, seq, op, rml=None):
        ts = __import__("datetime").datetime(2024, 1, 1, 0, 0, seq // 2)
        return (mapping_id, seq, ts, op, "simple" if op == "register" else None, "o", "p", "draft" if op == "register" else None, None, rml)

    log = [
        event("a", 1, "register", "1"), event("a", 2, "activate"), event("a", 3, "update", "2"),
        event("b", 4, "activate"), event("b", 5, "register", "3"),
        event("c", 6, "register", "4"), event("c", 7, "delete"), event("c", 8, "activate"),
        event("d", 9, "register", "5"), event("d", 10, "activate"), event("d", 11, "delete"), event("d", 12, "register", "6"),
    ]
    records = {row.id: row for row in current_records(spark.createDataFrame(log, EVENT_SCHEMA)).collect()}
    assert {key: (row.status, row.source, row.rml) for key, row in records.items()} == {
        "a": ("active", "rml", "2"), "b": ("draft", "simple", "3"), "d": ("draft", "simple", "6"),
    }


    # A state that is advanced by parts of the log, in any order and some of them twice, says the same.
    whole = spark.createDataFrame(log, EVENT_SCHEMA)
    for parts in ([(1, 4), (5, 8), (9, 12)], [(9, 12), (1, 8)], [(3, 7), (7, 12), (1, 4)]):
        state = None
        for begins, until in parts:
            state = advance(state, whole.where(F.col("seq").between(begins, until)))
        assert {row.id: row for row in records_of(state).collect()} == records


def test_no_text_in_an_aggregation_buffer(spark):
    plan = current_records(spark.createDataFrame([], EVENT_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate" in line and "max(" in line]
    assert aggregates and all("rml" not in line and "payload" not in line for line in aggregates)


def test_snapshots(workspace):
    assert workspace.snapshot() == 0
    first = workspace.register(declare().spec())["id"]
    second = workspace.register(declare().spec())["id"]
    workspace.delete(second)
    mark = workspace.snapshot()
    assert mark == workspace.snapshot() == 3
    before = sorted(map(str, workspace.records().collect()))
    assert before == sorted(map(str, current_records(workspace.events()).collect())) and len(before) == 1
    workspace.replace_rml(first, workspace.rml(first).replace("Gauge>", "Basin>"))
    third = workspace.register(declare().spec())["id"]
    assert sorted(map(str, workspace.records().collect())) == sorted(map(str, current_records(workspace.events()).collect()))
    assert "Basin>" in workspace.rml(first) and {r.id for r in workspace.list().collect()} == {first, third}
    assert workspace.snapshot() == 5 and workspace.records().count() == 2


def test_the_catalog_is_checked_after_a_projection(workspace, clean_catalog, monkeypatch):
    done = declare(workspace).register_and_project()
    mapping_id = done["mapping"]["id"]
    assert workspace.check([mapping_id]).count() == 0
    workspace.spark.sql("ALTER TABLE spark_catalog.default.gauges SET TBLPROPERTIES ('semantic.class' = 'X')")
    assert [(row.fact, row.actual) for row in workspace.check([mapping_id]).collect()] == [("semantic.class", "X")]
    monkeypatch.setattr(type(workspace), "project", lambda self, ids: {})
    with pytest.raises(RuntimeError, match="does not say what was projected"):
        declare(workspace).register_and_project()


def test_active_mappings_are_run(spark, workspace):
    """From the registry to triples: two mappings of one graph, planned one at a time."""
    from fixtures import GAUGES_DDL, ROWS

    gauges = spark.createDataFrame(ROWS, GAUGES_DDL)
    first, second = declare(workspace).register(), declare(workspace).register()
    for record in (first, second):
        workspace.activate(record["id"])
    workspace.materialize({"s3a://rivers/gauges": gauges}.__getitem__, lambda mapping_id: "g", batch=1)
    made = workspace.graph("g")
    # Both say the same, and a graph is a set.
    assert made.count() == 15 and made.where(F.col("o") == "Ammer").count() == 1


def test_unpublishable_documents_stop_the_publication(workspace):
    good = declare(workspace).register()
    workspace.activate(good["id"])
    before = workspace.graph().count()
    bad = Mapper(workspace).register_rml(EXPERT.replace("rr:subjectMap", 'rr:logicalTable [ rr:tableName "t" ] ; rr:subjectMap'))
    with pytest.raises(ValueError, match="logicalTable"):
        workspace.activate(bad["id"])
    assert [row.mapping_id for row in workspace.rejected().collect()] == [bad["id"]]
    assert workspace.graph().count() == before
    workspace.publish(skip_rejected=True)
    assert workspace.graph().count() == before


def test_updates_keep_other_graphs(spark, tmp_path):
    from tripleloom.operators.updates import update_graphs
    from tripleloom.sources import publish_graphs, read_graphs

    ddl = "graph string, s string, p string, o string, o_type string, o_datatype string, o_lang string"
    row = lambda g, s: (g, s, "p", "o", "uri", None, None)
    path = str(tmp_path / "store")
    publish_graphs(spark.createDataFrame([row("g1", "a"), row("g1", "a"), row("g2", "b"), row("g2", "c")], ddl), path)
    assert read_graphs(spark, path, "g1").count() == 1
    update_graphs(spark, path, ["g1"], lambda old: old.unionByName(spark.createDataFrame([row("g2", "new"), row("g2", "b")], ddl)))
    assert {r.s for r in read_graphs(spark, path, "g2").collect()} == {"b", "c", "new"}
    update_graphs(spark, path, ["g1"], lambda old: old.where("false"))
    assert {r.graph for r in read_graphs(spark, path).collect()} == {"g2"}


def test_two_projections_of_one_table_must_agree(workspace, clean_catalog):
    declare(workspace).register()
    other = declare(workspace)
    other.row_subject(rdf_class="dpa:Basin")
    other.register()
    with pytest.raises(RuntimeError, match="semantic.class"):
        workspace.project()
    assert workspace.jobs().count() == 0
    with pytest.raises(KeyError):
        workspace.project(["never-there"])


def test_a_projection_of_nothing_is_a_job(workspace):
    done = workspace.project([])
    assert workspace.job(done["id"])["mapping_count"] == 0
    assert workspace.job_mappings(done["id"]).count() == 0
