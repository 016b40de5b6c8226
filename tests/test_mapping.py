"""The declared example: its document, its triples, and the plan shapes."""

import pytest
from fixtures import GAUGES_DDL, GOLDEN, ROWS, SCHEMES, D, declare
from pyspark.sql import functions as F

from tripleloom import Mapper, plan_mapping, schemes_frame, specs_frame
from tripleloom.operators.materialize import distinct_triples, materialize, materialize_distinct, materialize_many, untyped_values
from tripleloom.operators.render import render_rml
from tripleloom.operators.rml_rules import _unescaped, document_triples, plan_batches, plans_from_rml, rejected_documents, triples_maps
from tripleloom.operators.turtle import corpus_of, mapping_projections
from tripleloom.plans import MappingPlan, TripleRule, expand, template_key
from tripleloom.vocab import RDF_TYPE, XSD


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture
def gauges(spark):
    return spark.createDataFrame(ROWS, GAUGES_DDL)


def test_document(spark):
    made = render_rml(specs_frame(spark, [declare().spec()]), schemes_frame(spark, SCHEMES))
    assert made.first().rml == GOLDEN


def test_document_without_columns(spark):
    spec = Mapper().dataset("a.b").subject_identifier(column="id", scheme="hydro:gauge").column("x").ignore().spec()
    text = render_rml(specs_frame(spark, [spec]), schemes_frame(spark, SCHEMES)).first().rml
    assert text.endswith("        rr:class <https://data-pipeline.local/ontology/Dataset>\n    ] .\n")
    assert 'rml:source "s3a://a/b"' in text and "unityCatalogColumn" not in text


def test_declarations_that_share_an_id_stay_apart(spark):
    from tripleloom.operators.registry import register_batch

    make = lambda comment: (
        Mapper().dataset("a.b.c").subject_identifier(column="id", scheme="hydro:gauge").column("x", "INT", comment).literal(predicate="p").spec()
    )
    specs = specs_frame(spark, [make("one"), make("two"), make("two")])
    schemes = schemes_frame(spark, SCHEMES)
    texts = [row.rml for row in render_rml(specs, schemes).collect()]
    assert len(texts) == 2 and all(text.count("unityCatalogColumn") == 1 for text in texts)
    events = register_batch(specs, schemes, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(events) == 3 and len({event.mapping_id for event in events}) == 2
    assert all(event.payload.count(comment) == event.rml.count(comment) for event in events for comment in ("one", "two"))


def test_triples(gauges):
    plan = plan_mapping(declare().spec(), SCHEMES)
    made = materialize(gauges, plan, "g")
    assert made.count() == 15 == distinct_triples(made).count()
    subject = "https://rivers.example/gauge/K-17"
    assert rows(made.where(F.col("s") == subject), "p", "o", "o_type", "o_datatype", "o_lang") == sorted(
        [
            (RDF_TYPE, D + "Gauge", "uri", None, None),
            (D + "code", "K-17", "literal", XSD + "string", None),
            (D + "river", "Ammer", "literal", XSD + "string", None),
            (D + "depth", "1.25", "literal", XSD + "double", None),
            (D + "inBasin", "https://rivers.example/basin/3", "uri", None, None),
        ],
        key=str,
    )


def test_shapes_agree(spark, gauges):
    plan = plan_mapping(declare().spec(), SCHEMES)
    odd = gauges.unionByName(gauges).unionByName(
        spark.createDataFrame([("Z", None, None, None, None), (None, "X", 1.0, 1, "Y")], GAUGES_DDL)
    )
    whole = materialize(odd, plan, "g")
    branches = materialize(odd, plan, "g", shape="branches")
    assert rows(whole, "*") == rows(branches, "*")
    assert rows(materialize_distinct(odd, plan, "g"), "*") == rows(whole.distinct(), "*")


def test_distinct_with_rules_that_overlap(spark):
    spec = (
        Mapper()
        .dataset("x")
        .subject_identifier(column="k", scheme="s")
        .column("a")
        .literal(predicate="dpa:same")
        .column("b")
        .literal(predicate="dpa:same")
        .column("a")
        .entity_reference(scheme="s", predicate="dpa:ref")
        .column("b")
        .entity_reference(scheme="t", predicate="dpa:ref")
        .column("a")
        .classification(term="dpa:T")
        .column("b")
        .classification(term="dpa:T")
        .spec()
    )
    plan = plan_mapping(spec, {"s": "http://x/{value}", "t": "http://x/1{value}"})
    df = spark.createDataFrame([(1.5, "12", "2"), (1.5, "2", "2"), (1.5, None, "ü é/")], "k double, a string, b string")
    assert rows(materialize_distinct(df, plan, "g"), "*") == rows(materialize(df, plan, "g").distinct(), "*")


def test_hot_subject_spreads(spark):
    """One key owns almost all rows; the set is still whole and shuffled by more than the key."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"), (F.col("id") % 1500).alias("v")
    )
    spec = Mapper().dataset("x").subject_identifier(column="k", scheme="s").column("v", "LONG").literal(predicate="p").spec()
    plan = plan_mapping(spec, {"s": "http://x/{value}"})
    made = materialize_distinct(df, plan, "g")
    assert made.count() == materialize(df, plan, "g").distinct().count()
    assert "hashpartitioning(k" in plan_text(made) and ", v" in plan_text(made).split("hashpartitioning(k")[1][:60]


def test_scan_reads_what_is_asked(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    from tripleloom.workloads.data import plan

    bound = plan_text(materialize(orders, plan("orders"), "g", predicate=D + "placedBy"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in bound
    branches = materialize(orders, plan("orders"), "g", shape="branches").where(F.col("p") == D + "orderStatus")
    assert plan_text(branches).count("FileScan") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan_text(branches)
    one = plan_text(
        materialize(orders, plan("orders"), "g", subject="https://data-pipeline.local/resource/orders/17")
    )
    assert "EqualTo(o_orderkey,17)" in one
    whole = plan_text(materialize(orders, plan("orders"), "g"))
    assert whole.count("FileScan") == 1 and "Exchange" not in whole and "Python" not in whole


@pytest.mark.parametrize("iri, count", [("orders/17", 5), ("orders/017", 0), ("orders/x", 0), ("customer/17", 0)])
def test_subject_bound(spark, iri, count):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    from tripleloom.workloads.data import plan

    made = materialize(orders, plan("orders"), "g", subject="https://data-pipeline.local/resource/" + iri)
    assert made.count() == count


def test_reading_a_document_back(spark, gauges):
    corpus = corpus_of(render_rml(specs_frame(spark, [declare().spec()]), schemes_frame(spark, SCHEMES)))
    [(name, source, plan)] = plans_from_rml(corpus)
    assert (name, source) == ("mapping-unity-default-gauges", "s3a://rivers/gauges")
    assert plan == plan_mapping(declare().spec(), SCHEMES)
    assert mapping_projections(corpus).count() == 1


def test_handwritten_document(spark):
    text = """@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix ex: <http://ex/> .
<#m> a rr:TriplesMap ; rml:logicalSource [ rml:source "s" ] ;
  rr:subjectMap [ rr:template "http://ex/{a}/of/{a}" ; rr:class ex:Thing ] ;
  rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rml:reference "weird \\"]\\" name" ] ; ] ;
  rr:predicateObjectMap [ rr:predicate ex:q ; rr:object <http://ex/o> ] ."""
    corpus = spark.createDataFrame([("d", "d", text)], "doc_id string, doc_order string, text string")
    [(_, _, plan)] = plans_from_rml(corpus)
    assert plan.subject_template == "http://ex/{value}/of/{value}" and plan.subject_column == "a"
    assert [rule.predicate for rule in plan.rules] == [RDF_TYPE, "http://ex/p", "http://ex/q"]
    assert plan.rules[1].column == 'weird "]" name' and plan.rules[2].constant == "http://ex/o"

    joined = text.replace("rr:object <http://ex/o>", "rr:objectMap [ rr:parentTriplesMap <#n> ]")
    bad = spark.createDataFrame([("d", "d", joined)], "doc_id string, doc_order string, text string")
    assert "rr:parentTriplesMap" in triples_maps(bad).first().problem
    with pytest.raises(ValueError, match="Unsupported construct"):
        plans_from_rml(bad)


def test_plan_errors():
    base = Mapper().dataset("x").subject_identifier(column="k", scheme="s")
    schemes = {"s": "http://x/{value}"}
    for spec, text in [
        (Mapper().dataset(" ").spec(), "dataset.name is required"),
        (Mapper().dataset("x").spec(), "requires column and scheme"),
        (Mapper().dataset("x").subject_identifier(column="k", scheme="t").spec(), "Unknown identifier scheme: t"),
        (base.column("c").entity_reference(scheme="s", predicate="").spec(), "entity reference mapping requires"),
    ]:
        with pytest.raises(ValueError, match=text):
            plan_mapping(spec, schemes)
    with pytest.raises(ValueError, match="columns not in the source table"):
        raise_missing()


def raise_missing():
    from pyspark.sql import SparkSession

    spec = Mapper().dataset("x").subject_identifier(column="nope", scheme="s").spec()
    materialize(SparkSession.getActiveSession().range(1), plan_mapping(spec, {"s": "{value}"}), "g")


def test_short_forms():
    assert expand("") == D
    assert expand("Thing") == D + "Thing"
    assert expand("dpa:a:b") == D + "a:b"
    assert expand("xsd:int") == XSD + "int"
    assert expand("sea:x:y") == D + "sea/x:y"
    assert expand("https://x") == "https://x"


def test_template_keys():
    assert template_key("http://x/{value}/y", "http://x/a%20b/y") == "a b"
    assert template_key("http://x/{value}", "http://y/1") is None
    assert template_key("http://x/{value}/{value}", "http://x/1/1") is None
    assert template_key("ab{value}ba", "aba") is None


HEAD = "@prefix rr: <http://www.w3.org/ns/r2rml#> .\n@prefix ex: <http://ex/> .\n"


def documents(spark, **texts):
    return spark.createDataFrame([(k, k, v) for k, v in texts.items()], "doc_id string, doc_order string, text string")


def test_all_classes_and_escapes_are_read(spark):
    text = HEAD + """<#m> a rr:TriplesMap ; dpa:unityCatalogColumn "id:INT:Key \\"id\\" x" ;
  rr:subjectMap [ rr:template "http://ex/{id}" ; rr:class ex:A , ex:B ; rr:class ex:C ] ;
  rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rml:reference "a\\tb\\u00e9" ] ] ."""
    corpus = documents(spark, d=text)
    assert rejected_documents(corpus).count() == 0
    [(_, _, plan)] = plans_from_rml(corpus)
    assert [rule.constant for rule in plan.rules[:3]] == ["http://ex/A", "http://ex/B", "http://ex/C"]
    assert plan.rules[3].column == "a\tb\u00e9"
    made = document_triples(corpus, "g")
    assert {row.o for row in made.where(F.col("p").endswith("#class")).collect()} == {"http://ex/A", "http://ex/B", "http://ex/C"}
    assert made.where(F.col("p").endswith("unityCatalogColumn")).first().o == 'id:INT:Key "id" x'


def test_what_cannot_be_read_is_rejected(spark):
    subject = 'rr:subjectMap [ rr:template "http://ex/{id}" ]'
    corpus = documents(
        spark,
        fine=HEAD + f"<#m> a rr:TriplesMap ; {subject} .",
        table=HEAD + f'<#m> a rr:TriplesMap ; rr:logicalTable [ rr:tableName "t" ] ; {subject} .',
        other=HEAD + f'<#m> a rr:TriplesMap ; ex:note "n" ; {subject} .',
        listed=HEAD + f"<#m> a rr:TriplesMap ; {subject} ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:object ex:o ] , [ rr:predicate ex:q ; rr:object ex:o ] .",
        renamed=HEAD.replace("rr:", "r2:") + f"<#m> a r2:TriplesMap ; {subject.replace('rr:', 'r2:')} .",
        nothing="<a> <b> <c> .",
        fact=HEAD + f'<#m> a rr:TriplesMap ; {subject} .\n<https://x/owner> <https://x/name> "Ann" .',
        unended=HEAD + f"<#m> a rr:TriplesMap ; {subject} .\n<#n> a rr:TriplesMap ; {subject} ;",
        escape=HEAD + f'<#m> a rr:TriplesMap ; dpa:unityCatalogObject "a\\x.b.c" ; {subject} .',
        no_code=HEAD + f'<#m> a rr:TriplesMap ; dpa:unityCatalogObject "a\\U00110000" ; {subject} .',
    )
    found = {row.mapping_id for row in rejected_documents(corpus).collect()}
    assert found == {"table", "other", "listed", "renamed", "nothing", "fact", "unended", "escape", "no_code"}


def test_escapes(spark):
    texts = [(r"r\U0001F600x", "r\U0001F600x"), (r"\uD83D\uDE00\u00e9", "\U0001F600\u00e9"), (r"\t\b\n\r\f\"\'\\", "\t\b\n\r\f\"'\\"), (r"a\\u0041", "a\\u0041"), ("plain é", "plain é"), ("", "")]
    frame = spark.createDataFrame(texts, "given string, wanted string").select("wanted", _unescaped(F.col("given")).alias("found"))
    assert all(row.found == row.wanted for row in frame.collect())


def test_plans_come_in_batches(spark):
    text = HEAD + "\n".join(f'<#m{i}> a rr:TriplesMap ; rr:subjectMap [ rr:template "http://ex/{i}/{{id}}" ] .' for i in range(7))
    batches = list(plan_batches(documents(spark, d=text), 3))
    assert [len(batch) for batch in batches] == [3, 3, 1]
    assert {plan.subject_template for batch in batches for _, _, plan in batch} == {f"http://ex/{i}/{{value}}" for i in range(7)}


def test_many_mappings_of_a_table(spark, gauges):
    """A thousand mappings of one table: the triples of each of them, in one scan."""
    table, plan = gauges, plan_mapping(declare().spec(), SCHEMES)
    other = MappingPlan("river", "http://ex/{value}/{value}", (
        TripleRule("http://ex/p", "uri", constant="http://ex/{value}"),
        TripleRule("http://ex/q", "literal", column="depth"),
        TripleRule("http://ex/r", "uri", column="code", template="http://ex/{value}"),
        TripleRule("http://ex/r", "literal", column="photo"),
    ))
    odd = table.union(spark.createDataFrame([(None, "a b/é", 1.0, 2, "{value}"), ("x y", None, None, None, None)], table.schema))
    jobs = [(plan, "g1"), (other, "g2"), (plan, "g1"), (MappingPlan("code", "{value}", ()), "g3")]
    wanted = [tuple(r) for p, g in jobs for r in materialize(odd, p, g).collect()]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in materialize_many(odd, jobs).collect())
    assert materialize_many(odd, []).count() == 0
    many = materialize_many(odd, [(other if i % 2 else plan, f"g{i}") for i in range(1000)])
    assert plan_text(many).count("Scan ") == plan_text(odd).count("Scan ")
    assert many.count() == 500 * (materialize(odd, plan, "g").count() + materialize(odd, other, "g").count())


def test_literals_of_declared_datatypes(spark):
    import datetime

    row = (1, 2.5, 3.0, 1e20, float("nan"), datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), 1, "07")
    table = spark.createDataFrame([row], "k int, half double, three double, big double, nan double, day date, at timestamp, flag int, text string")
    cases = {
        ("half", "integer"): None, ("three", "integer"): "3", ("big", "integer"): "100000000000000000000", ("big", "long"): None, ("three", "byte"): "3", ("nan", "integer"): None, ("half", "decimal"): "2.5",
        ("three", "decimal"): "3", ("three", "double"): "3.0", ("day", "dateTime"): "2024-01-02T00:00:00.000000", ("day", "date"): "2024-01-02",
        ("at", "date"): "2024-01-02", ("at", "dateTime"): "2024-01-02T03:04:05.000000", ("flag", "boolean"): "true", ("k", "boolean"): "true", ("text", "integer"): "07",
    }
    rules = tuple(TripleRule(f"{c}-{d}", "literal", column=c, datatype=XSD + d) for c, d in cases)
    plan = MappingPlan("k", "http://ex/{value}", rules)
    wanted = {f"{c}-{d}": text for (c, d), text in cases.items() if text is not None}
    for made in (materialize(table, plan, "g"), materialize(table, plan, "g", shape="branches"), materialize_distinct(table, plan, "g"), materialize_many(table, [(plan, "g")])):
        assert {r.p: r.o for r in made.collect()} == wanted
    failed = {(r.column, r.datatype.removeprefix(XSD)): r.rows for r in untyped_values(table, plan).collect()}
    assert failed == {key: 1 for key, text in cases.items() if text is None}
