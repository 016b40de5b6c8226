"""What only shows on larger tables: wide keys, small files whose rows make much, hot buckets."""

from pathlib import Path

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from tripleloom.sources import buckets
from tripleloom.sources.buckets import BucketedStore, buckets_for
from tripleloom.workloads import ALL, documents

SF_DIR = Path("/root/testdata/sf0.001")


@pytest.fixture
def with_table(spark, tmp_path):
    """The smallest tables with one of them made anew."""

    def make(name, change):
        for path in SF_DIR.glob("*.parquet"):
            if path.stem != name:
                (tmp_path / path.name).symlink_to(path)
        change(spark.read.parquet(str(SF_DIR / f"{name}.parquet"))).write.parquet(str(tmp_path / "made"))
        [written] = (tmp_path / "made").glob("*.parquet")
        (tmp_path / f"{name}.parquet").symlink_to(written)
        return str(tmp_path)

    return make


def test_lexical_form_of_users_beyond_the_small_type(spark, with_table):
    sf_dir = with_table("events", lambda events: events.withColumn("user_id", F.col("user_id") * 70_000).coalesce(1))
    assert not differences(ALL["lexical_form"], spark, connect(sf_dir), sf_dir)


def test_rows_of_a_small_file_meet_many_rules_in_many_tasks(spark):
    made = ALL["materialize_many"].run(spark, str(SF_DIR))
    tasks = made.groupBy(F.spark_partition_id().alias("task")).count().collect()
    counts = [row["count"] for row in tasks]
    assert len(counts) == 4 and max(counts) < sum(counts) / 2


def test_documents_are_written_in_many_tasks_and_once(spark):
    tasks = documents.specs(spark, str(SF_DIR)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 4
    found = documents.projections(spark, str(SF_DIR))
    assert "collect_set" not in found._jdf.queryExecution().toString()


def test_buckets_grow_with_the_graph():
    assert buckets_for(0) == 4 and buckets_for(1_000_001) == 5 and buckets_for(144_000_000) == 576


def test_sink_sets_the_session_of_the_batch(spark, monkeypatch):
    other = spark.newSession()
    seen = []
    original = buckets._by_subject
    monkeypatch.setattr(buckets, "_by_subject", lambda session: seen.append(session) or original(session))
    store = object.__new__(BucketedStore)
    store.spark, store.table = spark, "none"
    with pytest.raises(Exception):
        store._write(other.createDataFrame([], "graph string, s string, p string, o string, o_type string, o_datatype string, o_lang string"), "no_such_table")
    assert len(seen) == 1 and seen[0]._jsparkSession.equals(other._jsparkSession)


def test_published_rows_are_dealt_before_they_become_a_set(spark, tmp_path, monkeypatch):
    from tripleloom.workloads import tables

    tasks = []
    original = tables.publish_graphs
    counted = lambda made, path: tasks.append(made.select(F.spark_partition_id()).distinct().count()) or original(made, path)
    monkeypatch.setattr(tables, "publish_graphs", counted)
    tables.publish_graph(spark, str(SF_DIR))
    # Two small tables of one task each, and customers in four.
    assert tasks[0] == 6 and tasks[1] == 4


def test_characteristic_sets_of_a_star_are_counted_once(spark, monkeypatch):
    from tripleloom.operators import stars

    kept = []
    original = stars.stored
    monkeypatch.setattr(stars, "stored", lambda frame, label: kept.append(label) or original(frame, label))
    ALL["bgp_star_bag"].run(spark, str(SF_DIR))
    assert kept == ["characteristic-sets"]
