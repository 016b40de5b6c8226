"""Graph queries against brute force, storage, and streams."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleloom.model import TRIPLE_SCHEMA
from tripleloom.operators.graph import (
    Literal,
    Pattern,
    bgp_join,
    solutions,
    construct,
    delete_data,
    describe_node,
    minus,
    optional,
    order_patterns,
    triple_pattern,
)
from tripleloom.operators import condensation
from tripleloom.operators.condensation import path_components, strong_components
from tripleloom.operators.materialize import materialize
from tripleloom.operators.paths import path_closure
from tripleloom.operators.registry import dataset_profile
from tripleloom.operators.sampling import spark_pi
from tripleloom.operators.stars import bgp_star, characteristic_sets, star_estimates
from tripleloom.session import build_session, scratch_path, scratch_root, shuffle_partitions_for, stored
from tripleloom.sources import publish_graphs, read_graphs
from tripleloom.sources.buckets import BucketedStore
from tripleloom.sources.graphs import clear_graphs
from tripleloom.streaming import GraphSink
from tripleloom.workloads.data import plan


def graph(spark, rows):
    full = [("g", s, p, o, kind, datatype, lang) for s, p, o, kind, datatype, lang in rows]
    return spark.createDataFrame(full, TRIPLE_SCHEMA)


@pytest.fixture(scope="module")
def random_rows():
    draw = random.Random(5)
    rows = set()
    for _ in range(60):
        kind = draw.choice(["uri", "literal"])
        datatype = draw.choice(["int", "string", None]) if kind == "literal" else None
        rows.add((draw.choice("abcd"), draw.choice("pq"), draw.choice("abcd12"), kind, datatype, None))
    return sorted(rows, key=str)


def matches(pattern, triple, known):
    s, p, o, kind, datatype, lang = triple
    found = dict(known)
    for term, value in ((pattern.s, ("uri", s)), (pattern.p, ("uri", p)), (pattern.o, (kind, o, datatype, lang) if kind == "literal" else ("uri", o))):
        if isinstance(term, Literal):
            if value[0] != "literal" or value[1] != term.value or (term.datatype and value[2] != term.datatype):
                return None
        elif term.startswith("?"):
            if found.setdefault(term, value) != value:
                return None
        elif value != ("uri", term):
            return None
    return found


def brute_force(rows, patterns):
    found = [{}]
    for pattern in patterns:
        found = [new for old in found for row in rows if (new := matches(pattern, row, old)) is not None]
    return found


@pytest.mark.parametrize(
    "patterns",
    [
        [Pattern("?x", "p", "?y"), Pattern("?y", "q", "?z")],
        [Pattern("?x", "p", "?v"), Pattern("?y", "q", "?v")],
        [Pattern("?x", "?r", "?x")],
        [Pattern("?x", "p", Literal("1", "int")), Pattern("?x", "q", "?v")],
        [Pattern("?x", "p", "a"), Pattern("?x", "?r", "?y"), Pattern("?y", "?r", "?z")],
        [Pattern("?a", "p", "?b"), Pattern("?c", "q", "?d"), Pattern("?b", "q", "?c")],
    ],
)
def test_patterns(spark, random_rows, patterns):
    expected = brute_force(random_rows, patterns)
    made = solutions(bgp_join(graph(spark, random_rows), patterns))
    names = made.columns
    got = sorted(tuple(row[name] for name in names) for row in made.collect())
    assert got == sorted(tuple(solution["?" + name][1] for name in names) for solution in expected)


STARS = [
    [Pattern("?x", "p", "?y"), Pattern("?x", "q", "?z")],
    [Pattern("?x", "p", "?y"), Pattern("?x", "q", "?y"), Pattern("?x", "p", "?z")],
    [Pattern("?x", "p", "?y"), Pattern("?x", "q", "?z"), Pattern("?y", "p", "?v"), Pattern("?y", "q", "?w")],
    [Pattern("?x", "p", Literal("1", "int")), Pattern("?x", "q", "?v"), Pattern("?x", "p", "a")],
    [Pattern("?x", "p", "?x"), Pattern("?x", "q", "?v"), Pattern("?v", "?r", "?x")],
    [Pattern("?x", "p", "?v"), Pattern("?x", "q", "?w"), Pattern("?y", "q", "?v"), Pattern("?y", "p", "?w")],
    [Pattern("?x", "p", "?y")],
    [Pattern("?x", "p", "?y"), Pattern("?x", "none", "?z")],
]


@pytest.mark.parametrize("objects", [1, 1000])
@pytest.mark.parametrize("patterns", STARS)
def test_stars(spark, random_rows, patterns, objects):
    """With all objects in the subject's row, and with crowded predicates joined."""
    expected = brute_force(random_rows, patterns)
    made = solutions(bgp_star(graph(spark, random_rows), patterns, objects_per_row=objects))
    names = made.columns
    got = sorted(tuple(row[name] for name in names) for row in made.collect())
    assert got == sorted(tuple(solution["?" + name][1] for name in names) for solution in expected)


def test_stars_count_repeated_triples(spark, random_rows):
    """A triple that two graphs hold matches twice, as in a join."""
    twice = graph(spark, [*random_rows, *random_rows[:20]])
    for patterns in STARS[:3]:
        one, other = solutions(bgp_join(twice, patterns)), solutions(bgp_star(twice, patterns))
        assert sorted(map(tuple, one.select(sorted(one.columns)).collect())) == sorted(map(tuple, other.select(sorted(one.columns)).collect()))


def test_unconnected_stars_are_refused(spark, random_rows):
    with pytest.raises(ValueError, match="share no variable"):
        bgp_star(graph(spark, random_rows), [Pattern("?a", "p", "?b"), Pattern("?c", "q", "?d")])
    with pytest.raises(ValueError):
        bgp_star(graph(spark, random_rows), [])


def test_characteristic_sets(spark, random_rows):
    triples = graph(spark, random_rows)
    of_subject = {}
    for s, p, *_ in random_rows:
        of_subject.setdefault(s, Counter())[p] += 1
    expected = {}
    for counts in of_subject.values():
        expected.setdefault(tuple(sorted(counts)), []).append(counts)
    sets = characteristic_sets(triples)
    assert {tuple(r.predicates): (r.subjects, r.triples, r.most) for r in sets.collect()} == {
        key: (len(c), [sum(x[p] for x in c) for p in key], [max(x[p] for x in c) for p in key]) for key, c in expected.items()
    }
    found = star_estimates(sets, [["p"], ["p", "q"], ["none"]]).first()
    assert found.star_0 == sum(c["p"] for c in of_subject.values()) and found.star_2 == 0
    wanted = sum(len(c) * math.prod(sum(x[p] for x in c) / len(c) for p in "pq") for key, c in expected.items() if {"p", "q"} <= set(key))
    assert found.star_1 == pytest.approx(wanted)
    assert characteristic_sets(triples.limit(0)).count() == 0


def test_a_star_is_one_scan_and_no_join(spark, tmp_path):
    rows = [(f"s{i}", p, f"{p}{i % 3}", "uri", None, None) for i in range(40) for p in "pqrt"]
    publish_graphs(graph(spark, rows), str(tmp_path / "store"))
    sets = stored(characteristic_sets(read_graphs(spark, str(tmp_path / "store"))), "sets")
    made = bgp_star(read_graphs(spark, str(tmp_path / "store")), [Pattern("?s", p, f"?{p}") for p in "pqrt"], sets)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text and text.count("Exchange") == 1
    assert "In(p, [p,q,r,t])" in text
    assert made.count() == 40


def test_unconnected_patterns_are_refused(spark, random_rows):
    with pytest.raises(ValueError, match="share no variable"):
        bgp_join(graph(spark, random_rows), [Pattern("?a", "p", "?b"), Pattern("?c", "q", "?d")])
    with pytest.raises(ValueError):
        bgp_join(graph(spark, random_rows), [])


def test_no_cross_product_in_plan(spark, random_rows):
    made = bgp_join(graph(spark, random_rows), [Pattern("?x", "p", "?y"), Pattern("?y", "q", "?z")])
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_hub_is_one_row_in_a_semi_join(spark):
    """The right side is aggregated on the map side, and the join adds no shuffle to it."""
    from tripleloom.operators.graph import exists

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(50).select(F.col("id").cast("string").alias("x"))
        hub = F.when(F.col("id") % 10 != 0, F.lit(7)).otherwise(F.col("id"))
        right = spark.range(3000).select(hub.cast("string").alias("x"), F.col("id").alias("y"))
        made = exists(left, right)
        text = made._jdf.queryExecution().executedPlan().toString()
        assert {row.x for row in made.collect()} == {"0", "7", "10", "20", "30", "40"}
        assert text.count("Exchange hashpartitioning") == 2 and text.count("HashAggregate") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_of_queries(spark):
    rows = [("a", "p", "1", "literal", "int", None), ("b", "p", "1", "literal", "string", "en"), ("a", "q", "b", "uri", None, None)]
    triples = graph(spark, rows)
    left = bgp_join(triples, [Pattern("?s", "p", "?v")], typed=["v"])
    right = bgp_join(triples, [Pattern("?s", "q", "?t")])
    assert {tuple(row) for row in optional(left, right).select("s", "t").collect()} == {("a", "b"), ("b", None)}
    assert [row.s for row in minus(left, right).collect()] == ["b"]
    assert minus(left, right.select("t")).count() == 2
    made = construct(left, [Pattern("?s", "copy", "?v"), Pattern("?s", "of", "?s")], "h")
    assert {tuple(row)[1:] for row in made.collect()} == {
        ("a", "copy", "1", "literal", "int", None), ("b", "copy", "1", "literal", "string", "en"),
        ("a", "of", "a", "uri", None, None), ("b", "of", "b", "uri", None, None),
    }
    assert describe_node(triples, "b").count() == 2
    assert delete_data(triples, triples.where("s = 'b'")).count() == 2
    assert triple_pattern(triples, Pattern("?s", "?p", Literal("1", lang="en"))).count() == 1
    ordered = order_patterns([Pattern("?s", "p", "?v"), Pattern("?s", "?x", "?y"), Pattern("?s", "q", "?t")], {"p": 2, "q": 1})
    assert [pattern.p for pattern in ordered] == ["q", "p", "?x"]


def reach(edges):
    found = set(edges)
    while True:
        more = {(a, d) for (a, b), (c, d) in itertools.product(found, edges) if b == c} - found
        if not more:
            return found
        found |= more


def test_paths_with_cycles_and_a_hub(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("b", "c")] + [(f"n{i}", "hub") for i in range(30)] + [("hub", "a")]
    frame = spark.createDataFrame(edges, "source string, target string")
    closed = path_closure(frame)
    assert sorted(map(tuple, closed.collect())) == sorted(reach(set(edges)))
    starts = spark.createDataFrame([("hub",), ("alone",)], "start string")
    some = {tuple(row) for row in path_closure(frame, starts, include_start=True).collect()}
    assert some == {pair for pair in reach(set(edges)) if pair[0] == "hub"} | {("hub", "hub"), ("alone", "alone")}
    with pytest.raises(RuntimeError):
        path_closure(frame, max_rounds=1)
    assert path_closure(frame.limit(0)).count() == 0
    ends = spark.createDataFrame([("d",), ("alone",)], "node string")
    back = {tuple(row) for row in path_closure(frame, targets=ends, include_start=True).collect()}
    assert back == {pair for pair in reach(set(edges)) if pair[1] == "d"} | {("d", "d"), ("alone", "alone")}
    with pytest.raises(ValueError):
        path_closure(frame, starts, targets=ends)


@pytest.mark.parametrize("nodes, count", [(12, 14), (30, 36), (9, 40)])
def test_path_components(spark, nodes, count):
    draw = random.Random(count)
    edges = [(f"n{draw.randrange(nodes):02}", f"n{draw.randrange(nodes):02}") for _ in range(count)]
    edges += [edges[0], ("z", "z"), ("y", "z"), ("n00", None)]
    frame = spark.createDataFrame(edges, "source string, target string")
    pairs = reach({e for e in edges if e[1]})
    names = {n for e in edges if e[1] for n in e}
    component = {n: min([n, *[m for m in names if (n, m) in pairs and (m, n) in pairs]]) for n in names}
    size = Counter(component.values())
    assert dict(map(tuple, strong_components(frame).collect())) == component
    found = sorted(map(tuple, path_components(frame).collect()))
    assert found == sorted({(component[a], size[component[a]], component[b], size[component[b]]) for a, b in pairs})


def test_path_components_of_nothing(spark):
    empty = spark.createDataFrame([], "source string, target string")
    assert path_components(empty).count() == 0 and strong_components(empty).count() == 0


def test_path_components_compare_no_rounds(spark, monkeypatch):
    """Pairs are extended once, from the level they end in: no anti-join with pairs found before."""
    plans = []

    def watched(frame, label):
        plans.append((label, frame._jdf.queryExecution().optimizedPlan().toString()))
        return stored(frame, label)

    monkeypatch.setattr(condensation, "stored", watched)
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)] + [("n2", "n4")], "source string, target string")
    assert condensation.path_components(chain).count() == 15
    of_pairs = [text for label, text in plans if label == "pairs-level"]
    assert of_pairs and all("Join" not in text for text in of_pairs)


def test_path_components_number_nodes_without_joins(spark, monkeypatch):
    """Edges meet no table of nodes, and nodes that no edge leads to are in no table of levels."""
    plans = {}

    def watched(frame, label):
        plans.setdefault(label, []).append(frame._jdf.queryExecution().optimizedPlan().toString())
        return stored(frame, label)

    monkeypatch.setattr(condensation, "stored", watched)
    edges = spark.createDataFrame([(f"o{i}", f"c{i % 3}") for i in range(9)] + [("c0", "n"), ("n", "c0")], "source string, target string")
    assert condensation.path_components(edges).count() == 10
    assert all("Join" not in text for text in plans["edges"]) and all("Sort" not in text for text in plans["nodes"])
    assert condensation._levels(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "u long, v long")).count() == 2


def test_path_components_with_equal_hashes(spark, monkeypatch):
    """Nodes whose hashes are equal stay apart."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), ("e", "a")], "source string, target string")
    wanted = sorted(map(tuple, path_components(edges).collect()))
    monkeypatch.setattr(condensation, "_hashed", lambda values: F.pmod(F.xxhash64(values), F.lit(2)))
    assert sorted(map(tuple, path_components(edges).collect())) == wanted
    assert dict(map(tuple, strong_components(edges).collect())) == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_path_components_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(condensation, "PARTS", 2)
    for length in (3, 5, 6):
        chain = spark.createDataFrame([(i, i + 1) for i in range(length)], "source int, target long")
        found = sorted(map(tuple, path_components(chain).collect()))
        assert found == [(a, 1, b, 1) for a in range(length + 1) for b in range(a + 1, length + 1)]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    first = graph(spark, [("a", "p", "b", "uri", None, None)])
    second = first.withColumn("graph", F.lit("http://x/other graph?"))
    publish_graphs(first.unionByName(second), path)
    publish_graphs(first.limit(0), path)
    assert read_graphs(spark, path).count() == 2
    one = read_graphs(spark, path, "http://x/other graph?")
    assert one.collect() == second.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(graph" in plan
    assert clear_graphs(spark, path, ["g", "http://x/other graph?"], keep=first) == ["http://x/other graph?"]
    assert [row.graph for row in read_graphs(spark, path).collect()] == ["g"]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "n int, t string")
    expected = {("n", "int", 3, 0, 2), ("t", "string", 3, 1, 1)}
    assert {tuple(row) for row in dataset_profile(df).collect()} == expected
    assert {tuple(row) for row in dataset_profile(df, exact=False).collect()} == expected


def test_pi(spark):
    row = spark_pi(spark, 20000, 4).first()
    assert row.sample_count == 20000 and abs(row.pi - 3.14159) < 0.05
    assert spark_pi(spark, 20000, 2).first() == row


def test_scratch(spark):
    assert scratch_root(spark) == scratch_root(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert shuffle_partitions_for(10 << 40, 1000) == 81920
    assert shuffle_partitions_for(1, 8) == 8
    assert build_session(master="local[4]").sparkContext is spark.sparkContext


def test_stream_in_several_batches(spark, tmp_path):
    """A stream that arrives in pieces gives what the batch gives."""
    from tripleloom.operators.materialize import materialize
    from tripleloom.streaming import distinct_stream, materialize_stream, read_table_stream, run_available
    from tripleloom.workloads.data import plan

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    doubled = events.unionByName(events).repartition(5)
    doubled.write.parquet(str(tmp_path / "in"))
    rows = read_table_stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    stored = run_available(materialize_stream(rows, plan("events"), "g"), str(tmp_path / "a"), str(tmp_path / "ac"))
    batch = materialize(doubled, plan("events"), "g")
    assert stored.exceptAll(batch).count() == 0 and stored.count() == batch.count()
    rows = read_table_stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    once = run_available(
        distinct_stream(rows, plan("events"), "g", "ts", "90 days"), str(tmp_path / "b"), str(tmp_path / "bc")
    )
    assert sorted(once.drop("event_time").collect()) == sorted(batch.distinct().collect())


def _store_with(spark, path, rows, buckets=4):
    store = BucketedStore(spark, path, buckets)
    store.publish(graph(spark, rows))
    return store


def test_bucketed_store(spark, tmp_path, random_rows):
    path = str(tmp_path / "store")
    store = _store_with(spark, path, [*random_rows, *random_rows[:9]])
    in_other = [("other graph/\u00e9", s, p, o, kind, datatype, lang) for s, p, o, kind, datatype, lang in random_rows[:5]]
    other = spark.createDataFrame(in_other, TRIPLE_SCHEMA)
    store.insert(other.unionByName(graph(spark, random_rows[:20])))
    held = lambda s: sorted(map(tuple, s.read().collect()), key=str)
    everything = sorted([("g", *r) for r in random_rows] + in_other, key=str)
    assert held(store) == everything
    # Opened again, the store is the same; what it does not have is not taken away.
    again = BucketedStore(spark, path, 4)
    again.delete(graph(spark, [*random_rows[10:], ("none", "p", "a", "uri", None, None)]))
    assert held(again) == sorted([("g", *r) for r in random_rows[:10]] + in_other, key=str)
    again.delete(other)
    assert held(again) == sorted([("g", *r) for r in random_rows[:10]], key=str)
    assert again.read("g").count() == 10 and again.read("other graph/\u00e9").count() == 0


def test_bucketed_updates_do_not_shuffle_the_store(spark, tmp_path, random_rows):
    from tripleloom.sources.buckets import _by_subject

    store = _store_with(spark, str(tmp_path / "store"), random_rows)
    few = graph(spark, random_rows[:3])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with _by_subject(spark):
            for made in (store.fresh(few), store.remaining(few)):
                text = made._jdf.queryExecution().executedPlan().toString()
                assert "Bucketed: true" in text
                # What lies below an exchange is new: the scan of the store is under none.
                lines = text.splitlines()
                depth = lambda line: len(line) - len(line.lstrip(" :+-"))
                scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line or "FileScan parquet" in line and "graphs_" in line)
                above, level = [], depth(lines[scan])
                for line in reversed(lines[:scan]):
                    if depth(line) < level:
                        above.append(line)
                        level = depth(line)
                assert not any("Exchange hashpartitioning" in line for line in above)
                assert text.count("Exchange hashpartitioning(s") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """Late rows go aside, rows without time are in time, and a batch that runs again writes the same."""
    import datetime

    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    schema = "event_id long, ts timestamp, event_type string, user_id long"
    batches = [
        [(1, at(1), "a", 1), (2, at(9), "b", 2)],
        [(3, at(7), "c", 1), (4, at(6, 23), "late", 1), (5, None, "no time", 3)],
        [],
        [(6, at(20), "d", 1), (7, at(1), "late too", None)],
    ]
    sink = GraphSink(BucketedStore(spark, str(tmp_path / "graphs"), 2), plan("events"), "g", "ts", "2 days", str(tmp_path / "sink"))
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    for order in ([0, 1], [1, 2, 3], [0, 1, 2, 3]):
        for batch_id in order:
            sink(frames[batch_id], batch_id)
    late = sink.late(spark, frames[0].schema)
    assert sorted((r.event_id, r.batch_id, r.missed) for r in late.collect()) == [(4, 1, at(7)), (7, 3, at(7))]
    kept = spark.createDataFrame([row for rows in batches for row in rows if row[0] not in (4, 7)], schema)
    wanted = materialize(kept, plan("events"), "g")
    assert sorted(map(str, sink.store.read().collect())) == sorted(map(str, wanted.collect()))
