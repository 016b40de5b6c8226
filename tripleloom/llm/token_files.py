"""Token ids in files: canonical length-limited Huffman codes, in blocks that decode by table and on their own.

A written corpus is a folder of two tables:

* ``codebook``: one row (id, length) for each id that occurs. Codes are canonical: ids in the order of (length, id) get
  ascending codes, so the lengths are all a reader needs.
* ``blocks``: one row per block of documents: block (a number; ascending numbers follow ascending doc_ids), doc_ids,
  sizes (ids of each), checkpoints (the bit at which every ``STRIDE``-th id starts) and bits.

Blocks are read independently of each other, and within a block all strides advance together, one table look-up for
each id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import NO_ID, ids_of, plain, ship, shuffle_parts, slices, stored
from .tokens import encoder

LIMIT = 16
STRIDE = 128
#: Text in one block at most, or one document.
TEXT_BYTES = 8 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for ids with these counts, by package-merge; 0 for absent ids."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    weights, kinds = leaves, []
    kinds.append(np.ones(len(leaves), bool))
    for _ in range(limit - 1):
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        weights = both[sort]
        kinds.append(sort < len(leaves))
    take = 2 * len(leaves) - 2
    for leaf in reversed(kinds):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes for these lengths."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    # Each code takes its share of the full range, counted in units of the longest code.
    share = 1 << (LIMIT - lengths[order])
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (np.cumsum(share) - share) >> (LIMIT - lengths[order])
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, first bit highest, and where every stride starts."""
    size = lengths[ids]
    ends = np.cumsum(size)
    checkpoints = (ends - size)[::STRIDE]
    # Four codes of at most 16 bits make one number of at most 64.
    pad = -len(ids) % 4
    size4 = np.concatenate([size, np.zeros(pad, np.int64)]).reshape(-1, 4)
    code4 = np.concatenate([codes[ids], np.zeros(pad, np.uint64)]).reshape(-1, 4)
    value, width = code4[:, 0], size4[:, 0]
    for k in range(1, 4):
        value = (value << size4[:, k].astype(np.uint64)) | code4[:, k]
        width = width + size4[:, k]
    start = np.cumsum(width) - width
    word, bit = start >> 6, start & 63
    room = 64 - bit - width
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    over = np.nonzero(room < 0)[0]
    low = value[over] << (64 + room[over]).astype(np.uint64)
    total = int(ends[-1]) if len(ids) else 0
    out = np.zeros(total // 64 + 2, np.uint64)
    first = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
    heads = np.nonzero(first)[0]
    if len(heads):
        out[word[heads]] = np.bitwise_or.reduceat(high, heads)
    out[word[over] + 1] |= low  # at most one code crosses each border
    return out.astype(">u8").tobytes()[: (total + 7) // 8], checkpoints


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each ``LIMIT`` bits: the id whose code they begin with, and its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    share = 1 << (LIMIT - lengths[order])
    ids, sizes = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.int64)
    ids[: share.sum()] = np.repeat(order, share)
    sizes[: share.sum()] = np.repeat(lengths[order], share)
    return ids, sizes


def decode_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``n`` ids; all strides are decoded side by side."""
    ids, sizes = table
    data = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
    three = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((len(at), STRIDE), np.uint32)
    last = 8 * (len(three) - 1)
    for k in range(min(STRIDE, n)):
        window = (three[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[:, k] = ids[window]
        at = np.minimum(at + sizes[window], last)
    return out.reshape(-1)[:n]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    coder = encoder(path)
    for batch in slices(batches, limit=TEXT_BYTES):
        ids = coder.encode(plain(batch.column("text")), end)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids_of(batch.column("doc_id"))], pa.list_(pa.int64())),
                pa.array([np.diff(ids.starts)], pa.list_(pa.int64())),
                pa.array([squeeze.compress(ids.flat.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary()),
            ],
            ["doc_ids", "sizes", "raw"],
        )


def _raw(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("raw"):
            own = np.bincount(_raw(raw.as_py()))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
    used = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes = codes_of(lengths)
    for batch in batches:
        for row in range(batch.num_rows):
            own = batch.slice(row, 1)
            bits, checkpoints = encode_bits(_raw(own.column("raw")[0].as_py()), lengths, codes)
            yield pa.RecordBatch.from_arrays(
                [own.column("block"), own.column("doc_ids"), own.column("sizes"), pa.array([checkpoints], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                ["block", "doc_ids", "sizes", "checkpoints", "bits"],
            )


_BLOCK = "block long, doc_ids array<long>, sizes array<long>, checkpoints array<long>, bits binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1) -> None:
    """Write every text of ``docs`` (doc_id, text) to the folder ``path``, in ascending doc_id order.

    A text is its ids by the tokenizer file and then ``end``; null is an empty text. A null doc_id comes first; rows
    with one doc_id come in the order of a hash of their texts. The texts are sorted across the cluster and encoded
    once; counts of ids combine in each task, and only the totals, one per vocabulary entry, reach the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    ranged = keyed.repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    raw = "doc_ids array<long>, sizes array<long>, raw binary"
    # The number has the range in its upper bits and counts on within it: blocks in the order of their documents.
    numbered = ranged.mapInArrow(lambda batches: _encoded(batches, tokenizer, end), raw).withColumn("block", F.monotonically_increasing_id())
    numbered = stored(numbered, "ids")
    rows = numbered.select("raw").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for row in rows:
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    book = [(int(i), int(lengths[i])) for i in np.nonzero(lengths)[0]]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    numbered.mapInArrow(lambda batches: _blocks(batches, lengths), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def _read(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    table = decode_table(lengths)
    for batch in batches:
        for row in range(batch.num_rows):
            value = lambda c: batch.column(c)[row]  # noqa: B023, E731
            sizes = np.array(value("sizes").as_py(), np.int64)
            ids = decode_bits(value("bits").as_py(), np.array(value("checkpoints").as_py(), np.int64), int(sizes.sum()), table)
            ends = np.cumsum(sizes)
            own = [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            n = len(own)
            columns = {
                "doc_id": pa.array(value("doc_ids").as_py(), pa.int64()),
                "block": pa.array([value("block").as_py()] * n, pa.int64()),
                "first": pa.array(ends - sizes),
                "n_tokens": pa.array(sizes),
                "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in own], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([i.astype(np.int32) for i in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a written corpus: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the
    ids if asked for. The result is decoded from the files.
    """
    ship(spark)
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r.id for r in book), default=-1) + 1, np.int64)
    for row in book:
        lengths[row.id] = row.length
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    schema = "doc_id long, block long, first long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = blocks.mapInArrow(lambda batches: _read(batches, lengths, with_ids), schema)
    sizes = blocks.select("block", F.shiftright("block", 33).alias("shard"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    # Sums within each range first; one row for each range is all that is summed in one place.
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("ahead"))
    inner = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    before = sizes.withColumn("inner", inner).join(shards, "shard").select("block", (F.col("inner") + F.col("ahead")).alias("before"))
    kept = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    back = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return rows.join(before, "block").select(back, (F.col("before") + F.col("first")).alias("start"), *kept)
