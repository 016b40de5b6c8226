"""Prefix trie against sequences held whole; running sums against a plain loop."""

import brute
import numpy as np
import pytest
import xxhash
from conftest import SF_DIR
from pyspark.sql import functions as F

from tripleloom.llm import prefix_trie as module
from tripleloom.llm.prefix_trie import prefix_trie
from tripleloom.llm.queries import QUERIES
from tripleloom.llm.running import SUM, XOR, running

FIELDS = "conv_id long, turn long, role string, text string"


def _tie(role, text):
    """The hash that orders rows of one turn, as a signed number."""
    seed = xxhash.xxh64_intdigest(role.encode(), 42)
    value = xxhash.xxh64_intdigest(text.encode(), seed)
    return (value - (1 << 64) if value >> 63 else value,)


def _rows(frame):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert frame.columns == columns
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _rows(QUERIES["op13_prefix_trie"](spark, SF_DIR)) == brute.prefix_trie(rows, _tie)


def _messy():
    rng = np.random.default_rng(4)
    rows = []
    for conv in range(60):
        # Few different turns, so that many conversations are alike or begin alike.
        rows += [(conv, t, ("user", "bot")[t % 2], f"text {rng.integers(0, 2)}" * (t + 1)) for t in range(int(rng.integers(1, 14)))]
    rows += [(70, None, "user", "before all"), (70, 0, None, None), (70, 0, "", "x"), (70, 0, "", "x"), (70, 1, "user", "été 😀")]
    rows += [(71, 3, "user", "")] * 12 + [(None, 1, "user", "nobody's")]
    rows += [(-3, t, "user", f"m{t}") for t in range(12)] + [(-5, t, "user", f"n{t}") for t in range(3)] + [(-1, 1, "bot", "m")]
    return rows


def test_messy_rows(spark):
    rows = _messy()
    table = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("own") for c in ("pos", "depth", "h1", "m1", "p1", "one", "tie", "_task", "weight", "first")})
    assert _rows(prefix_trie(table.repartition(3))) == brute.prefix_trie(rows, _tie)


def test_small_chunks_of_ids(spark, monkeypatch):
    """One conversation that many hold: their ids travel in several texts."""
    rows = [(c, 0, "user", "hello") for c in range(-40, 160)] + [(c, 1, "bot", "hi") for c in range(0, 160, 3)]
    monkeypatch.setattr(module, "CHUNK", 12)
    whole = [tuple(r) for r in rows]
    assert _rows(prefix_trie(spark.createDataFrame(rows, FIELDS))) == brute.prefix_trie(whole, _tie)


def test_long_conversation(spark):
    """One that has most of all turns lies in several tasks."""
    rows = [(10, t, "user", f"t{t % 7}") for t in range(600)] + [(10 + c, t, "user", f"t{t % 7}") for c in range(1, 9) for t in range(9 + c)]
    assert _rows(prefix_trie(spark.createDataFrame(rows, FIELDS).repartition(4))) == brute.prefix_trie(rows, _tie)


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], FIELDS)).count() == 0


@pytest.mark.parametrize("keys", [1, 2, 50])
def test_running_sums(spark, keys):
    rng = np.random.default_rng(keys)
    rows = [(int(rng.integers(0, keys)), i, int(rng.integers(-(1 << 62), 1 << 62)), int(rng.integers(0, 9))) for i in range(3000)]
    table = spark.createDataFrame(rows, "k long, at long, bits long, n long").repartition(5)
    found = running(table, "k", [F.desc("at")], {"x": ("bits", XOR), "s": ("n", SUM)}, "running-test")
    held = {(r.k, r["at"]): (r.x, r.s) for r in found.collect()}
    sums = {}
    for k, at, bits, n in sorted(rows, key=lambda r: -r[1]):
        x, s = sums.get(k, (0, 0))
        sums[k] = (x ^ bits, s + n)
        assert held[k, at] == sums[k]
