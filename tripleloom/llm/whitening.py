"""Whitening of embeddings from exact integer cross-products.

1. Every entry c becomes the whole number x = floor(256 c). The fit list holds each distinct x vector once.
2. Bit-sliced scatter: a task shifts each dimension of some thousand vectors to start at zero and stores its bit planes
   vertically, 64 vectors to a word. The sum of products of two dimensions is the sum of 2**(a + b) times the bits that
   plane a of one and plane b of the other have in common: an AND and a population count. Shifts are taken back exactly,
   so what tasks report are sums of products of the x themselves, whatever the cut into tasks.
3. The driver gets one number for each pair of dimensions, centres them as integers (n * sum(x_i x_j) - S_i S_j) and
   takes the eigenvectors. Its memory depends on the number of dimensions only, never on rows.
4. A second pass over the rows projects them; the covariance of the whitened fit list is measured, not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ship, stored

#: Vectors whose planes are compared at once; planes of 64 dimensions then fit into a core's cache.
SLICE_ROWS = 4096
COMPONENTS = 4
#: Cross-products are reported in two parts, so that sums of any size stay exact in decimals of 38 digits.
SPLIT = 10**18


class Whitening(NamedTuple):
    """``axes`` has a column per component; eigenvalues too small to divide by have no column."""

    n: int
    sums: list[int]
    axes: np.ndarray
    scales: np.ndarray
    explained: list[float | None]

    @property
    def width(self) -> int:
        return len(self.sums)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` whole numbers as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(-1, width)


def planes_of(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of a matrix of unsigned numbers: words, and the column and power of each plane."""
    rows, width = shifted.shape
    padded = -(-rows // 64) * 64
    words, owner, power = [], [], []
    for bit in range(int(shifted.max(initial=0)).bit_length()):
        bits = ((shifted >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        used = np.nonzero(bits.any(axis=0))[0]
        held = np.zeros((len(used), padded), np.uint8)
        held[:, :rows] = bits[:, used].T
        words.append(np.packbits(held, axis=1, bitorder="little").view(np.uint64))
        owner.append(used)
        power.append(np.full(len(used), bit))
    if not words:
        return np.zeros((0, padded // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(owner), np.concatenate(power)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of x_i x_j over the rows of ``x``, as Python integers, by AND and population count."""
    width = x.shape[1]
    least = x.min(axis=0)
    shifted = x.astype(np.uint64) - least.astype(np.uint64)
    words, owner, power = planes_of(shifted)
    # Sums of products of shifted numbers stay below 2**62 unless the numbers themselves are large.
    exact = np.int64 if 2 * (int(power.max(initial=0)) + 1) + len(x).bit_length() < 62 else object
    products = np.zeros((width, width), exact)
    weight = np.array([1 << int(p) for p in power], exact)
    for at in range(len(words)):
        common = np.bitwise_count(words[at] & words[at:]).sum(axis=1, dtype=np.int64).astype(exact)
        part = np.zeros(width, exact)
        np.add.at(part, owner[at:], common * weight[at:] * weight[at])
        # The pair of a plane with itself is one term of the diagonal; other pairs stand in both halves.
        part_self = common[0] * weight[at] * weight[at]
        part[owner[at]] -= part_self
        products[owner[at]] += part
        products[:, owner[at]] += part
        products[owner[at], owner[at]] += part_self
    products = products.astype(object)
    low = least.astype(object)
    sums = x.astype(object).sum(axis=0) - low * len(x) if exact is object else (x - least).sum(axis=0).astype(object)
    return products + np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + len(x) * np.multiply.outer(low, low)


def _scattered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One task's sums: rows (i, j, high, low); row (-1, -1) has the number of vectors, rows (-1, j) sums of x_j."""
    total, sums, n = np.zeros((width, width), object), np.zeros(width, object), 0
    for batch in batches:
        x = matrix(batch.column("x"), width)
        for at in range(0, len(x), SLICE_ROWS):
            part = x[at : at + SLICE_ROWS]
            total = total + cross_products(part)
            sums = sums + part.astype(object).sum(axis=0)
            n += len(part)
    if not n:
        return
    i, j = np.tril_indices(width)
    rows = [(-1, -1, n), *((-1, int(d), sums[d]) for d in range(width)), *zip(i.tolist(), j.tolist(), total[i, j].tolist())]
    split = [divmod(int(value), SPLIT) for _, _, value in rows]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([high for high, _ in split]).cast(pa.decimal128(38, 0))
            if all(abs(high) < 1 << 62 for high, _ in split)
            else pa.array([str(high) for high, _ in split]).cast(pa.decimal128(38, 0)),
            pa.array([low for _, low in split], pa.int64()),
        ],
        ["i", "j", "high", "low"],
    )


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a whole vector of finite entries, in whole 256ths as column ``x``."""
    c = F.col(vector)
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.coalesce(whole, F.lit(False))).withColumn("x", F.transform(c, lambda e: F.floor(e.cast("double") * 256)))


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Axes and scales from a table of distinct x vectors of one width; None if it is empty."""
    found = distinct.mapInArrow(lambda batches: _scattered(batches, width), "i int, j int, high decimal(38,0), low long")
    rows = found.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    value = {(r.i, r.j): int(r.high) * SPLIT + int(r.low) for r in rows}
    if not value:
        return None
    n, sums = value[-1, -1], [value[-1, d] for d in range(width)]
    covariance = np.zeros((width, width))
    trace = 0
    for i in range(width):
        for j in range(i + 1):
            centred = n * value[i, j] - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = centred / (n * n)
            trace += centred if i == j else 0
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    apart = e > max(float(e[0]), 0.0) * width * np.finfo(float).eps
    explained = [max(float(v), 0.0) / (trace / (n * n)) if trace else None for v in e]
    return Whitening(n, sums, q[:, apart], np.sqrt(e[apart]), explained)


def projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """Whitened coordinates, and the exact squared length of n x - S where 64 bits hold it."""
    largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * model.n + max(abs(s) for s in model.sums)
    small = model.width * largest**2 < 1 << 63
    apart = x.astype(np.int64 if small else object) * model.n - np.array(model.sums, np.int64 if small else object)
    squares = (apart * apart).sum(axis=1).tolist()
    exact = (apart.astype(np.float64) if small else np.array([[v / 1 for v in row] for row in apart.tolist()], np.float64).reshape(x.shape)) / model.n
    return exact @ model.axes / model.scales, [s if s < 1 << 63 else None for s in squares]


def _projected(batches: Iterator[pa.RecordBatch], model: Whitening, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            whitened, deviation = projected(matrix(part.column("x"), model.width), model)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(whitened) + 1) * whitened.shape[1], pa.int32()), pa.array(whitened.ravel())
            )
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(deviation, pa.int64()), lists], [*keep, "deviation", "whitened"])
    pa.default_memory_pool().release_unused()


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row of ``rows`` and component: the key, component, n, deviation, whitened, explained, identity_error.

    A row is usable if its vector is not null and not empty, and no entry is null, infinite or not a number. If usable
    vectors have several lengths, those of the commonest length count (of equally common ones the longest), others are
    not usable either. Each row is judged by itself: repeated keys stay, null keys stay null. Other columns are neither
    looked at nor returned, whatever their names. A vector that many rows share counts once in the fit, and is combined
    before it is shuffled.

    ``n`` vectors are in the fit list, ``deviation`` is the exact sum of (n x - S)**2 over the dimensions (null where
    64 bits do not hold it). There are as many components as dimensions if these are fewer. A component in which the
    fit list does not vary has ``whitened`` null and ``explained`` 0 (null if it varies in none). ``identity_error`` is
    the largest deviation of the whitened fit list's measured covariance from the identity, over components that vary;
    null if none does. An empty table gives no rows.
    """
    ship(rows.sparkSession)
    whole = usable(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector").select("key", "x")
    lengths = whole.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("width")).first()
    names = f"`{key}` {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return rows.sparkSession.createDataFrame([], names)
    width = common.width
    whole = whole.where(F.size("x") == width)
    distinct = stored(whole.select("x").distinct(), "whitening-fit")
    model = fit(distinct, width, components)
    count = len(model.scales)
    schema = "deviation long, whitened array<double>"
    of_fit = distinct.mapInArrow(lambda batches: _projected(batches, model, []), schema)
    pairs = [(a, b) for a in range(count) for b in range(a + 1)]
    error = None
    if pairs:
        measured = of_fit.agg(*(F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
        error = max(abs(measured[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    found = whole.mapInArrow(lambda batches: _projected(batches, model, ["key"]), f"key {dict(whole.dtypes)['key']}, {schema}")
    parts = F.array(
        *(
            F.struct(
                F.lit(c + 1).alias("component"),
                (F.col("whitened")[c] if c < count else F.lit(None).cast("double")).alias("whitened"),
                F.lit(model.explained[c]).cast("double").alias("explained"),
            )
            for c in range(len(model.explained))
        )
    )
    return found.select("key", "deviation", F.inline(parts)).select(
        F.col("key").alias(key),
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
