"""Dictionaries, documents in parts, sketches, keys instead of IRIs, results of unknown variables."""

import random

import pytest
from pyspark.sql import functions as F

from tripleloom.operators.graph import bindings_variant, bound_cells, cell
from tripleloom.operators.lookup import look_up
from tripleloom.operators.materialize import dangling_keys, dangling_references, materialize
from tripleloom.operators.registry import SKETCH_ERROR, dataset_profile, merge_profiles, profile_sketches
from tripleloom.operators.turtle import mapping_projections, ontology_classes, split_statements, ttl_prefixes, ttl_statements
from tripleloom.plans import MappingPlan, TripleRule
from tripleloom.sources import read_corpus, read_corpus_lines


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _rows(spark):
    words = ["hot"] * 300 + ["a", "b", "unknown", "", None] * 20
    return spark.createDataFrame(list(enumerate(words)), "id long, word string")


def _expected(found):
    words = {"hot": 1, "a": 2, "": 3}
    rows = found.collect()
    assert len(rows) == 400 and found.columns == ["id", "word", "n"]
    assert all(r.n == words.get(r.word) for r in rows)


def test_look_up_by_measured_size(spark):
    words = spark.createDataFrame([("hot", 1), ("a", 2), ("", 3)], "w string, n int")
    found = look_up(_rows(spark), F.col("word"), words, "w")
    _expected(found)
    assert "BroadcastHashJoin" in plan_text(found)


def test_look_up_spreads_hot_words(spark, no_broadcast):
    words = spark.createDataFrame([("hot", 1), ("a", 2), ("", 3)], "w string, n int")
    found = look_up(_rows(spark), F.col("word"), words, "w", salts=8)
    _expected(found)
    assert "Broadcast" not in plan_text(found)
    dealt = _rows(spark).withColumn("salt", F.pmod(F.xxhash64("id", "word"), F.lit(8))).where("word = 'hot'").groupBy("salt").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 75


def test_look_up_in_nothing(spark, no_broadcast):
    found = look_up(_rows(spark), F.col("word"), spark.createDataFrame([], "w string, n int"), "w")
    assert found.where("n is null").count() == 400


CORPUS = [
    ("d1", "@prefix dpa: <https://d/> .\ndpa:A a owl:Class ;\n rdfs:label \"first\" .\n<https://d/A> a owl:Class ;\n rdfs:label \"last\" .\n"),
    ("d2", '<m>\n    a rr:TriplesMap ;\n    dpa:unityCatalogObject "u.d.t" ;\n    rr:subjectMap [\n        rr:class dpa:A\n    ] .\n'),
]


def test_statements_do_not_travel_by_prefix(spark, no_broadcast):
    corpus = spark.createDataFrame([(i, i, text) for i, text in CORPUS], "doc_id string, doc_order string, text string")
    classes = ontology_classes(corpus)
    assert [(r.iri, r.label) for r in classes.collect()] == [("https://d/A", "last")]
    found = mapping_projections(corpus)
    assert [(r.full_name, r.class_iri) for r in found.collect()] == [("u.d.t", "https://d/A")]
    exchanges = [line for line in plan_text(found).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("_salt" in line or "_copy" in line for line in exchanges)
    assert ttl_prefixes(corpus).count() == 1


HARD = [
    "@prefix x: <y> .", "# comment that ends.", "", "a b", "c d .", "  e f ;   ", "@prefix late: <z> .", " \t", "g h . 　", "i.", "#", "j\x0bk .\x85l m",
    "n 'o. p' ;", "q .", "open tail",
]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_parts_of_documents(spark, tmp_path, end):
    rng = random.Random(7)
    for name in ("one.ttl", "two.ttl"):
        lines = [rng.choice(HARD) for _ in range(1500)]
        (tmp_path / name).write_bytes(end.join(lines).encode())
    (tmp_path / "empty.ttl").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        lines = read_corpus_lines(spark, str(tmp_path))
        assert lines.select("doc_id", "part").distinct().count() > 20
        found = split_statements(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    corpus = read_corpus(spark, str(tmp_path))
    assert corpus.count() == 2  # an empty file has no row
    whole = ttl_statements(corpus).collect()
    assert whole and sorted((r.doc_id, r.stmt_pos, r.statement) for r in found) == sorted((r.doc_id, r.stmt_pos, r.statement) for r in whole)


def test_profiles_add_up(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 7).alias("part"),
        F.when(F.col("id") % 3 != 0, F.col("id") % 20_011).alias("a.b"),
        F.lit(None).cast("double").alias("none"),
        F.array(F.col("id") % 5).alias("list"),
    )
    kept = profile_sketches(rows, F.col("part"))
    assert kept.count() == 7 * 4
    exact = {r.column_name: r for r in dataset_profile(rows).collect()}
    merged = merge_profiles(kept.where("part < 4").unionByName(kept.where("part >= 4"))).collect()
    assert len(merged) == 4
    for r in merged:
        e = exact[r.column_name]
        assert (r.type_name, r.row_count, r.null_count) == (e.type_name, e.row_count, e.null_count)
        assert abs(r.distinct_count - e.distinct_count) <= SKETCH_ERROR * e.distinct_count
    assert {r["count"] for r in merge_profiles(kept, "part").groupBy("part").count().collect()} == {4}
    assert merge_profiles(profile_sketches(rows.limit(0), F.col("part"))).count() == 0


def _link(*rules, template="http://x/{value}"):
    return MappingPlan("id", template, tuple(rules))


def _both(links, plan, subjects, subject_plan):
    by_key = dangling_keys(links, plan, "p", subjects, subject_plan)
    by_iri = dangling_references(materialize(links, plan, "g", predicate="p"), materialize(subjects, subject_plan, "g"))
    found = sorted(map(tuple, by_key.collect()))
    assert found == sorted(map(tuple, by_iri.select("p", "o", "reference_count").collect()))
    return found, by_key


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dangling_keys(spark, kind):
    links = spark.createDataFrame([(1, 1, 7), (2, 9, None), (3, 9, 9), (None, 8, 8), (4, None, None)], "id long, a int, b int")
    links = links.withColumns({"a": F.col("a").cast(kind), "b": F.concat(F.col("b").cast("string"), F.lit(" é/")) if kind == "string" else F.col("b")})
    subjects = spark.createDataFrame([(1,), (1,), (None,), (5,)], "id long").withColumn("id", F.col("id").cast(kind))
    typed = _link(TripleRule("t", "uri", constant="c"))
    one, two = TripleRule("p", "uri", column="a", template="http://x/{value}"), TripleRule("p", "uri", column="b", template="http://x/{value}")
    found, frame = _both(links, _link(one, two), subjects, typed)
    assert (kind == "string") == any("%20é%2F" in o for _, o, _ in found) and ("p", "http://x/9", 2 if kind == "string" else 3) in found
    if kind == "long":
        top, _, below = frame._jdf.queryExecution().optimizedPlan().toString().partition("Join")
        assert "http://x/" in top and "http://x/" not in below
    # Other templates, constants and templates without a slot are compared as IRIs.
    other = TripleRule("p", "uri", column="b", template="http://x/y{value}")
    _both(links, _link(one, other), subjects, typed)
    _both(links, _link(one, TripleRule("p", "uri", constant="http://x/5")), subjects, typed)
    _both(links, _link(TripleRule("p", "uri", column="a", template="http://x")), subjects, _link(TripleRule("t", "uri", constant="c"), template="http://x"))
    assert dangling_keys(links, _link(one), "q", subjects, typed).count() == 0


def test_results_of_any_variables(spark):
    texts = [
        '{"results": {"bindings": [{"x": {"type": "uri", "value": "u"}, "weird name": {"type": "literal", "value": "", "xml:lang": "en"}}, {}]}}',
        '{"results": {"bindings": [{"y": {"type": "literal", "value": "1"}, "z": null, "w": {"type": "literal"}}]}}',
        '{"results": {}}', '{"results": {"bindings": 3}}', '[]', 'no json', '', None,
    ]
    rows = bindings_variant(spark.createDataFrame(list(enumerate(texts)), "result_id int, json string"))
    assert rows.count() == 3
    found = sorted(map(tuple, bound_cells(rows).collect()))
    assert found == [(0, 0, "weird name", "", "literal"), (0, 0, "x", "u", "uri"), (1, 0, "y", "1", "literal")]
    asked = rows.orderBy("result_id", "row_index").select(cell("x"), cell("weird name", "xml:lang"), cell("nobody")).collect()
    assert [tuple(r) for r in asked] == [("u", "en", None), (None, None, None), (None, None, None)]
