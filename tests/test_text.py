"""Turtle text, names and literals: the behaviours that are easy to get wrong."""

import datetime

import pytest
from fixtures import ONTOLOGY, SCHEMES
from pyspark.sql import functions as F

from tripleloom import Mapper, schemes_frame, specs_frame
from tripleloom.functions import expand_curie, iri_label, iri_safe, iri_suffixes, lexical_form, record_id, strip
from tripleloom.operators.render import render_rml
from tripleloom.operators.turtle import (
    bad_columns,
    catalog_columns,
    corpus_of,
    ontology_classes,
    ontology_summary,
    term_lookup,
    ttl_prefixes,
    ttl_statements,
)
from tripleloom.operators.validate import raise_on_error, shacl_min_count, unknown_schemes, validate_specs
from tripleloom.sources import conform, read_corpus, read_schemes, scheme_by_id


def corpus(spark, *texts):
    return spark.createDataFrame(
        [(f"d{i}", i, text) for i, text in enumerate(texts)], "doc_id string, doc_order bigint, text string"
    )


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first().r


def cut(spark, text):
    return [row.statement for row in ttl_statements(corpus(spark, text)).orderBy("stmt_pos").collect()]


def cut_slowly(text):
    """What cutting means, line by line."""
    done, held = [], []
    for line in text.splitlines():
        bare = line.strip()
        if bare and not bare.startswith(("#", "@prefix")):
            held.append(line)
            if bare.endswith("."):
                done.append("\n".join(held))
                held = []
    return done


@pytest.mark.parametrize(
    "text",
    [
        "",
        ".",
        "a b c .\n",
        "a\nb.\n\n# no.\n@prefix x: <y> .\nc .  \t\nd",
        "a\r\nb.\r\nc\u2028d.\x85e\x0bf.\x1c g.",
        "  # indented comment.\n  a ;\n\u3000b .\u00a0\n...\n",
        'x "multi.\nline" .\ny',
        "a.b.c\n. . .\n.\n\u00a0\nlast.",
        "no end at all " * 2000,
        ("dots . " * 50 + "\n") * 200 + "end.",
    ],
)
def test_statements(spark, text):
    assert cut(spark, text) == cut_slowly(text)


def test_documents_do_not_run_into_each_other(spark):
    found = ttl_statements(corpus(spark, "open", "closed ."), keep_empty=True)
    assert {(row.doc_id, row.statement) for row in found.collect()} == {("d0", None), ("d1", "closed .")}


def test_prefixes(spark):
    found = ttl_prefixes(
        corpus(spark, "@prefix a: <1> .\n@prefix : <2> .\n@prefix b-c:  <3>.", "x @prefix a: <4> . @prefix 9: <5> .")
    )
    assert {(row.prefix, row.iri) for row in found.collect()} == {("a", "4"), ("b-c", "3")}


def test_ontology(spark):
    classes = ontology_classes(corpus(spark, ONTOLOGY))
    assert {(row.label, row.comment) for row in classes.collect()} == {
        ("River gauge", "A place where water levels are read."),
        ("Basin", ""),
        ("Reading", "One level at one time."),
    }
    assert ontology_summary(classes, schemes_frame(spark, SCHEMES)).first() == (3, 2)
    terms = spark.createDataFrame([("Gauge",), ("ontology/Gauge",), ("auge",)], "term string")
    found = {row.term: row.label for row in term_lookup(terms, classes).collect()}
    assert found == {"Gauge": "River gauge", "ontology/Gauge": "River gauge", "auge": None}


def test_later_class_wins_but_keeps_its_place(spark):
    classes = ontology_classes(
        corpus(spark, 'p:A a owl:Class ; rdfs:label "old" .\nq:A a owl:Class .', "p:A a rdfs:Class .")
    )
    rows = {row.iri: (row.label, row.first_order, row.first_pos) for row in classes.collect()}
    assert rows == {"p:A": ("p:A", 0, 0), "q:A": ("q:A", 0, 1)}


def test_escaped_quotes_cut_an_annotation(spark):
    spec = (
        Mapper()
        .dataset("a.b.c")
        .subject_identifier(column="id", scheme="hydro:gauge")
        .column("x", "STRING", 'say "hi" now')
        .classification(term="")
        .column("y:z", "INT", "a: b: c")
        .literal(predicate="p")
        .spec()
    )
    documents = render_rml(specs_frame(spark, [spec]), schemes_frame(spark, SCHEMES))
    assert "rr:object <https://data-pipeline.local/ontology/>" in documents.first().rml
    found = catalog_columns(corpus_of(documents)).collect()
    assert [(row.name, row.comment) for row in found] == [("x", "say \\")]
    # A colon in a name shifts the parts.
    assert bad_columns(corpus_of(documents)).first().detail == "Unsupported dpa:unityCatalogColumn type: Z"


def test_comment_keeps_its_colons(spark):
    text = '<m> dpa:unityCatalogObject "a.b.c" ; rr:class <C> ; dpa:unityCatalogColumn " n : int : a: b " .'
    row = catalog_columns(corpus(spark, text)).first()
    assert (row.name, row.type_name, row.comment, row.position) == ("n", "INT", "a: b", 0)
    assert row.type_json == '{"name":"n","type":"integer","nullable":true,"metadata":{}}'


def test_validation_rows(spark):
    spec = (
        Mapper(ontology="other", profile="odd")
        .dataset(" ")
        .subject_identifier(column="", scheme="nope")
        .column("c")
        .entity_reference(scheme="", predicate="")
        .spec()
    )
    specs = specs_frame(spark, [spec])
    assert {row.rule for row in validate_specs(specs).collect()} == {
        "ontology",
        "profile",
        "dataset_name",
        "subject_identifier",
        "predicate",
    }
    details = {row.detail for row in unknown_schemes(specs, schemes_frame(spark, SCHEMES)).collect()}
    assert details == {"Unknown identifier scheme: nope", "Unknown identifier scheme: "}
    with pytest.raises(ValueError, match="Unknown identifier scheme"):
        raise_on_error(unknown_schemes(specs, schemes_frame(spark, SCHEMES)))
    assert render_rml(specs, schemes_frame(spark, SCHEMES)).first().rml is None


def test_min_count(spark):
    ddl = "graph string, s string, p string, o string, o_type string, o_datatype string, o_lang string"
    from tripleloom.vocab import RDF_TYPE

    triples = spark.createDataFrame(
        [
            ("g", "a", RDF_TYPE, "C", "uri", None, None),
            ("g", "b", RDF_TYPE, "C", "uri", None, None),
            ("g", "b", "p", "x", "literal", None, None),
            ("g", "c", RDF_TYPE, "C", "literal", None, None),
            ("g", "d", "p", "x", "literal", None, None),
        ],
        ddl,
    )
    assert [row.focus_node for row in shacl_min_count(triples, "C", "p").collect()] == ["a"]
    assert {row.focus_node for row in shacl_min_count(triples, "C", "p", 2).collect()} == {"a", "b"}


@pytest.mark.parametrize(
    "iri, label",
    [(None, ""), ("", ""), ("http://x/y", "y"), ("http://x/y#", "y"), ("http://x/y#z", "z"), ("http://x/", ""),
     ("http://x/y>>", "y>"), ("a/b", "b"), ("plain", "plain"), ("x#y/z", "z")],
)
def test_labels(spark, iri, label):
    assert one(spark, iri_label, iri) == label


@pytest.mark.parametrize(
    "value, safe",
    [("a-b_c.d~9", "a-b_c.d~9"), ("a b/c", "a%20b%2Fc"), ("*+%", "%2A%2B%25"), ("é日本", "é日本"),
     ("ü x\u0085", "ü%20x%C2%85"), ("\ue000𝒳", "%EE%80%80𝒳"), ("", ""), (None, None)],
)
def test_iri_safe(spark, value, safe):
    assert one(spark, iri_safe, value) == safe


def test_other_text_functions(spark):
    assert one(spark, strip, "\u3000\t x y \x85") == "x y"
    assert one(spark, expand_curie, ":x") == "https://data-pipeline.local/ontology//x"
    assert one(spark, iri_suffixes, "http://a/b#c") == ["/a/b#c", "a/b#c", "b#c", "c"]
    assert one(spark, record_id, '{"id": "m"}') == "m"
    assert one(spark, record_id, "m") == "m"
    assert one(spark, record_id, "{}") is None


def test_lexical_forms(spark):
    df = spark.createDataFrame(
        [(True, float("inf"), float("-inf"), float("nan"), datetime.date(2024, 2, 3), bytearray(b"\x00\xff"))],
        "b boolean, i double, j double, n double, d date, y binary",
    ).withColumn("t", F.to_timestamp_ntz(F.lit("2024-03-10 02:30:00.5")))
    types = {field.name: field.dataType for field in df.schema.fields}
    row = df.select(*[lexical_form(F.col(name), types[name]).alias(name) for name in df.columns]).first()
    assert tuple(row) == ("true", "INF", "-INF", "NaN", "2024-02-03", "00FF", "2024-03-10T02:30:00.500000")


def test_local_times_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS t")
        assert df.select(lexical_form(F.col("t"), df.schema["t"].dataType).alias("r")).first().r == "2024-03-10T02:30:00.000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "..hidden").mkdir()
    (tmp_path / "b.ttl").write_text("two .")
    (tmp_path / "deep" / "a.ttl").write_text("three .\n")
    (tmp_path / "..hidden" / "c.ttl").write_text("none .")
    (tmp_path / "note.txt").write_text("none .")
    found = read_corpus(spark, str(tmp_path)).orderBy("doc_order").collect()
    assert [row.text.strip() for row in found] == ["two .", "three ."]


def test_scheme_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"schemes": [\n {"id": "a", "template": "1/{value}"},\n {"id": "b", "label": "B", "template": "2"},'
        ' {"id": "a", "label": "A", "template": "3"}]}'
    )
    found = read_schemes(spark, str(tmp_path))
    assert {tuple(row) for row in found.collect()} == {("a", "A", "3"), ("b", "B", "2")}
    assert scheme_by_id(found, "b").first().template == "2"
    with pytest.raises(ValueError):
        scheme_by_id(found, "c")


def test_conform_refuses_what_does_not_fit(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType())])
    assert conform(spark.range(2), schema).schema["id"].dataType == T.IntegerType()
    with pytest.raises(Exception):
        conform(spark.createDataFrame([("x",)], "id array<string>"), schema).collect()
