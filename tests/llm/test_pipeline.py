"""The pipeline against its stages by brute force, and the registered SQL."""

from collections import Counter

import brute
import corpus_pipeline
import pytest
from conftest import CLASHING, SF_DIR
from oracle import connect
from pyspark.sql import functions as F

from tripleloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    answer = connect(SF_DIR).sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, SF_DIR).select(answer.columns).collect()
    assert Counter(map(tuple, found)) == Counter(answer.fetchall())


def test_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def tables(spark, docs):
    held, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF_DIR).cache()
        out[name] = held
    yield out
    for frame in out.values():
        frame.unpersist()


def _texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages(spark, docs, tables):
    whole = _texts(docs)
    known = _texts(tables["language"])
    assert set(known) <= set(whole) and len(known) >= 0.98 * len(whole)
    near = brute.near_duplicates(sorted(known.items()), 5)
    apart = _texts(tables["near_dedup"])
    assert apart == {i: known[i] for i, (_, _, kept) in near.items() if kept}
    cut = _texts(tables["substring_dedup"])
    rows = brute.window_dedup(sorted(apart.items()))
    assert set(cut) == {i for i, (n, gone, _) in rows.items() if gone == 0 or gone < n}
    for i, text in cut.items():
        assert text == apart[i] if rows[i][1] == 0 else brute.sha(text.encode()) == rows[i][2]
    assert all(r.n_chars == len(r.text) for r in tables["substring_dedup"].collect() if rows[r.doc_id][1])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {i for i, row in brute.decontaminate(sorted(cut.items()), items).items() if not row[-1]}
    left = _texts(tables["decontamination"])
    assert set(left) == clean
    assert {r.doc_id for r in tables["packing"].collect()} == clean
    for name in ("language", "near_dedup", "substring_dedup", "decontamination"):
        assert tables[name].columns == docs.columns


def test_run_gives_the_pieces_of_the_last_stage(spark, tables):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).select(columns).collect())) == sorted(map(tuple, tables["packing"].select(columns).collect()))


def test_stages_on_messy_and_empty_tables(spark, messy, empty):
    for table in (messy.drop(*CLASHING), empty.drop(*CLASHING), messy.withColumn("extra", F.lit(1))):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, SF_DIR)
            assert found.count() <= table.count() * 100
