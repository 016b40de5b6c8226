"""SimHash components against all pairs."""

import brute
import numpy as np
import pytest
from conftest import SF_DIR, by_id
from pyspark.sql import functions as F

from tripleloom.llm import simhash
from tripleloom.llm.components import components
from tripleloom.llm.queries import QUERIES
from tripleloom.llm.simhash import close_pairs, links, simhash_components

ROW = ("fingerprint", "component_id")


def test_query(spark, pairs):
    assert by_id(QUERIES["op11_simhash"](spark, SF_DIR), *ROW) == brute.simhash(pairs)


def test_odd_texts(odd, odd_pairs):
    found = by_id(simhash_components(odd), *ROW)
    assert found == brute.simhash(odd_pairs)
    # No words: zero, and linked with each other.
    assert found[1] == found[2] == found[3] == ("0" * 16, 1)


def test_messy_and_empty_tables(messy, empty):
    found = simhash_components(messy)
    assert found.columns == ["doc_id", *ROW] and found.count() == messy.count()
    # A row without id is a text like any other, and takes the smallest id of those alike.
    assert sorted(r.component_id for r in found.where("doc_id is null").collect()) == [4, 6]
    # The text of 9 also stands in a row with id 6, the smaller one.
    assert {r.component_id for r in found.where("doc_id in (6, 9)").collect()} == {6}
    assert simhash_components(empty).count() == 0


def test_nothing_but_rows_without_id(spark):
    found = simhash_components(spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string"))
    assert [r.component_id for r in found.collect()] == [None, None]


def _distances(values):
    apart = values[:, None] ^ values[None, :]
    return np.bitwise_count(apart)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_close_pairs(radius, monkeypatch):
    """In buckets that begin and end inside words, with runs of blocks that break buckets."""
    monkeypatch.setattr(simhash, "BLOCKS", 37)
    rng = np.random.default_rng(radius)
    centers = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = centers[rng.integers(0, 6, 400)]
    for _ in range(4):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    ends = np.array([0, 1, 63, 64, 130, 131, 300, 399])
    last = np.repeat(ends, np.diff([-1, *ends]))
    found = {p for i, j in close_pairs(values, last, radius) for p in zip(i.tolist(), j.tolist())}
    near = _distances(values) <= radius
    assert found == {(i, j) for i in range(400) for j in range(i + 1, last[i] + 1) if near[i, j]}


@pytest.mark.parametrize("limit", [16, 1024])
def test_large_buckets_are_cut_again(spark, limit):
    """A cluster of which every bucket of the first cut is too large, beside far ones."""
    rng = np.random.default_rng(3)
    near = np.full(700, 0x0123456789ABCDEF, np.uint64)
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 20, 700).astype(np.uint64))
    values = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.array([0, (1 << 64) - 1, 1 << 63], np.uint64)]))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "bits long")
    found = {r.node: r.root for r in components(links(table, 2, limit)).collect()}
    root = np.arange(len(values))
    close = _distances(values) <= 2
    while True:
        low = np.where(close, root[None, :], len(values)).min(axis=1)
        if (low == root).all():
            break
        root = low
    parts, wanted = {}, {}
    for place, value in enumerate(values.view(np.int64).tolist()):
        parts.setdefault(root[place], set()).add(value)
        wanted.setdefault(found.get(value, value), set()).add(value)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values()))


def test_copies_are_one_node(spark):
    """A third of all rows with one text, another third with near ones: one component each, no pairs of copies."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(300 + i, " ".join([*base[:200], f"x{i}", *base[201:]])) for i in range(100)]
    rows += [(400 + i, f"other {i} {i * i} {i + 7} words {i}") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(simhash_components(table), *ROW) == brute.simhash(rows)


def test_wide_radius_needs_room(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "bits long"), 2, 8)
