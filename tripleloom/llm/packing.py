"""Best-fit packing of token sequences, planned on the histogram of lengths.

Only how many pieces have each length matters for a packing, and there are at most ``capacity`` lengths. The histogram
is the one thing that reaches the driver; the plan made from it says, for runs of equally long pieces, which sequences
and which offset they get. Pieces then learn their number within their length from counts per bucket, and look
themselves up in the plan; no list of pieces is ever gathered.

The plan: pieces above a third of the capacity can share a sequence with at most one more of their kind. From the
largest down, each is matched with the largest that fits, which makes the fewest sequences for them. Smaller pieces
then go, from the largest down, to the sequence with the least gap that still holds them.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import plain, ship, shuffle_parts, slices, stored
from .tokens import encoder

CAPACITY = 2048
#: Texts are encoded in larger slices: the more text, the more of it repeats.
TEXT_BYTES = 8 << 20


class Plan(NamedTuple):
    """Runs, sorted by length and first number: pieces ``first`` to ``first + count`` of a length go to sequences from
    ``sequence`` on, at ``offset``.
    """

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of ``histogram[length]`` pieces of each length; its size depends on ``capacity`` alone."""
    left = {length: n for length, n in histogram.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    # Groups of sequences filled alike: their contents as (length, how many), how many sequences, and the gap.
    groups: dict[int, list[tuple[tuple, int]]] = {}

    def put(gap: int, contents: tuple, n: int) -> None:
        groups.setdefault(gap, []).append((contents, n))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        top = large[-1]
        at = bisect.bisect_right(large, capacity - top) - 1
        if at < 0:
            put(capacity - top, ((top, 1),), left.pop(top))
            large.pop()
            continue
        mate = large[at]
        if mate == top:
            pairs, single = divmod(left.pop(top), 2)
            large.pop()
            if pairs:
                put(capacity - 2 * top, ((top, 2),), pairs)
            if single and large:
                # The odd one goes with the largest of the rest.
                mate = large[-1]
                left[mate] -= 1
                put(capacity - top - mate, ((top, 1), (mate, 1)), 1)
                if not left[mate]:
                    large.pop()
                    del left[mate]
            elif single:
                put(capacity - top, ((top, 1),), 1)
            continue
        n = min(left[top], left[mate])
        put(capacity - top - mate, ((top, 1), (mate, 1)), n)
        for length in (top, mate):
            left[length] -= n
            if not left[length]:
                large.remove(length)
                del left[length]

    for length in sorted(left, reverse=True):
        n = left[length]
        gaps = sorted(g for g in groups if g >= length)
        for gap in gaps:
            if not n:
                break
            fit, old = gap // length, groups.pop(gap)
            for i, (contents, bins) in enumerate(old):
                if not n:
                    for rest in old[i:]:
                        put(gap, *rest)
                    break
                full = min(bins, n // fit)
                n -= full * fit
                if full:
                    put(gap - fit * length, (*contents, (length, fit)), full)
                bins -= full
                if bins and n:
                    put(gap - n * length, (*contents, (length, n)), 1)
                    bins, n = bins - 1, 0
                if bins:
                    put(gap, contents, bins)
        if n:
            fit = capacity // length
            if n >= fit:
                put(capacity - fit * length, ((length, fit),), n // fit)
            if n % fit:
                put(capacity - n % fit * length, ((length, n % fit),), 1)

    taken: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for gap in sorted(groups):
        for contents, bins in groups[gap]:
            offset = 0
            for length, times in contents:
                for _ in range(times):
                    rows.append((length, taken.get(length, 0), bins, sequence, offset))
                    taken[length] = taken.get(length, 0) + bins
                    offset += length
            sequence += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in slices(batches, limit=TEXT_BYTES):
        ids = coder.encode(plain(batch.column("text")), end)
        rows, arrays = [], []
        for i in range(batch.num_rows):
            own = ids.flat[ids.starts[i] : ids.starts[i + 1]].astype("<u4")
            head = len(own) % capacity or capacity
            cuts = [0, *range(min(head, len(own)), len(own) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                rows.append((i, piece, a, b - a, zlib.crc32(own[a:b].tobytes())))
                if with_ids:
                    arrays.append(own[a:b].astype(np.int32))
        at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
        columns = [batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(arrays, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def _looked_up(batches: Iterator[pa.RecordBatch], made: Plan) -> Iterator[pa.RecordBatch]:
    # Length and number in one key; numbers of a length start at 0, so runs of one length follow each other.
    edges = {int(n): (int(a), int(b)) for n, a, b in zip(*np.unique(made.length, return_index=True), np.append(np.unique(made.length, return_index=True)[1][1:], len(made.length)))}
    for batch in batches:
        lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        run = np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            a, b = edges[n]
            own = lengths == n
            run[own] = a + np.searchsorted(made.first[a:b], numbers[own], side="right") - 1
        columns = {name: batch.column(name) for name in batch.schema.names if name not in ("number", "bucket", "nth", "before")}
        columns["sequence_id"] = pa.array(made.sequence[run] + numbers - made.first[run])
        columns["offset"] = pa.array(made.offset[run])
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) as pieces with their place in a sequence of at most ``capacity`` ids.

    A text is its ids by the tokenizer file ``tokenizer`` and then ``end``; null is an empty text. Only longer ones are
    cut, into pieces of ``capacity`` ids of which the first may be shorter. Rows: doc_id, piece, start, length,
    ids_crc32, sequence_id (from 0, gapless) and offset; with ``with_ids`` also the ids. Rows that repeat an id are
    packed each for itself, null ids too; other columns are not looked at. No documents give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    extra = ", ids array<int>" if with_ids else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    cut = docs.select("doc_id", "text").mapInArrow(lambda batches: _pieces(batches, tokenizer, end, capacity, with_ids), schema + extra)
    cut = stored(cut, "pieces")
    made = plan({row.length: row["count"] for row in cut.groupBy("length").count().collect()}, capacity)
    buckets = shuffle_parts(spark)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = cut.withColumn("nth", nth).join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("nth") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return numbered.select(*columns, "number").mapInArrow(
        lambda batches: _looked_up(batches, made), schema + extra + ", sequence_id long, offset long"
    )
