"""Whitening against exact integers and plain linear algebra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tripleloom.llm.queries import QUERIES
from tripleloom.llm.whitening import cross_products, whiten

FIELDS = "vec_id long, embedding array<double>"


def _whole(vector):
    return tuple(math.floor(256 * float(c)) for c in vector)


def _check(found, rows):
    """``rows`` are (key, vector) of usable rows."""
    x = {k: _whole(v) for k, v in rows}
    fit = sorted(set(x.values()))
    n, width = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(width)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], object)
    exact = centred.T @ centred
    covariance = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in exact])
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1], q[:, ::-1]
    place = {v: i for i, v in enumerate(fit)}
    number = min(4, width)
    assert len(found) == number * len(rows)
    whitened = np.full((n, number), np.nan)
    for r in found:
        own = centred[place[x[r.vec_id]]]
        assert (r.n, r.deviation) == (n, sum(int(c) ** 2 for c in own))
        if r.whitened is None:
            assert e[r.component - 1] < 1e-9 * max(e[0], 1)
            continue
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(covariance), rel=1e-6)
        wanted = (np.array([float(c) for c in own]) / n) @ q[:, r.component - 1] / math.sqrt(e[r.component - 1])
        assert abs(r.whitened) == pytest.approx(abs(wanted), rel=1e-5, abs=1e-6)
        whitened[place[x[r.vec_id]], r.component - 1] = r.whitened
    held = whitened[:, ~np.isnan(whitened).any(axis=0)]
    if held.size:
        apart = held - held.mean(axis=0)
        error = np.abs(apart.T @ apart / n - np.eye(held.shape[1])).max()
        assert error < 1e-4 and all(r.identity_error == pytest.approx(error, abs=1e-9) for r in found)
    else:
        assert {r.identity_error for r in found} == {None}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    _check(QUERIES["op12_whitening"](spark, SF_DIR).collect(), rows)


@pytest.mark.parametrize("scale", [3, 300, 1 << 40])
def test_cross_products_are_exact(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale, (130, 7))
    x[:, 3] = 5
    assert (cross_products(x) == x.astype(object).T @ x.astype(object)).all()


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, -0.25, 0.001]), (2, [0.5, -0.25, 0.0011]), (3, [-1.0, 2.0, 7.0]), (4, [0.1, 0.1, 0.1]), (5, [0.0, -0.0, -9.0]), (6, [3.0, 1.0, 0.5])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [1.0, inf, 2.0]), (10, [-inf, 1.0, 1.0]), (11, [nan, 1.0, 1.0]), (12, []), (13, [1.0, 2.0])]
    table = spark.createDataFrame(good + bad, FIELDS).withColumns({c: F.lit("own") for c in ("x", "key", "n", "deviation", "whitened", "vector", "component")})
    found = whiten(table)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _check(found.collect(), good)
    # 1 and 2 are one x vector: the fit list has five.
    assert {r.n for r in found.collect()} == {5}


def test_repeats_and_rows_without_key(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 0.5])]
    once = {(r.vec_id, r.component): abs(r.whitened) for r in whiten(spark.createDataFrame(rows, FIELDS)).collect()}
    table = spark.createDataFrame(rows * 30 + [(None, [1.0, 2.0])], FIELDS)
    found = whiten(table).collect()
    assert len(found) == 2 * 91
    assert all(abs(r.whitened) == pytest.approx(once[r.vec_id or 1, r.component]) for r in found)


def test_no_variation(spark):
    _check(whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], FIELDS)).collect(), [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    flat = [(i, [float(i), 2.0 * i, 1.0, 0.0, 4.0]) for i in range(9)]
    _check(whiten(spark.createDataFrame(flat, FIELDS)).collect(), flat)


def test_large_numbers(spark):
    rows = [(1, [1e12, 1.0]), (2, [-1e12, 5.0]), (3, [3e11, 2.0])]
    found = whiten(spark.createDataFrame(rows, FIELDS)).collect()
    # (n x - S)**2 is beyond 64 bits.
    assert {r.deviation for r in found} == {None} and found[0].identity_error < 1e-4


def test_empty(spark):
    found = whiten(spark.createDataFrame([], FIELDS))
    assert found.count() == 0 and len(found.columns) == 7
    assert whiten(spark.createDataFrame([(1, None)], FIELDS)).count() == 0
