"""SimHash near-duplicates: fingerprints of three-word shingles, compared bit-sliced within buckets.

1. Each text gets 64 bits: bit k is set if it is set in more than half of its shingles' hashes.
2. Equal fingerprints are one node from here on, whatever the number of copies.
3. Fingerprints that differ in at most ``radius`` of ``radius + 2`` parts agree in two parts: for each choice of two,
   those bits are the bucket. A bucket with more than ``LIMIT`` members is not compared: its free bits are cut into
   parts again, and so on. As fingerprints are distinct, buckets with few free bits are small, so this ends with every
   pair still meeting in some bucket, and no bucket is large.
4. Within buckets fingerprints are stored as bit planes, 64 members to a word. Each member's distances to 64 others
   are counted at once, plane by plane, in carry-save counters; a word is abandoned as soon as all of its members
   exceed the radius. A bucket reports the links that join what was apart, at most one a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import plain, ship, shuffle_parts, slices, stored, words_of
from .components import components

WORDS, RADIUS, SEED = 3, 2, 42
#: Members that a bucket may have before its free bits are cut once more.
LIMIT = 1024
#: Rows compared together (whole buckets), words of members looked at together, and hashes unpacked together.
TOGETHER, BLOCKS, UNPACKED = 1 << 15, 1 << 15, 1 << 16
#: Planes between two looks for words to abandon.
PATIENCE = 8
ALL = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and how many each text has."""
    found = words_of(pc.ascii_lower(texts))
    counts = found.counts
    joined = found.joined()
    data = joined.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    sizes = pc.binary_length(found.flat).to_numpy(zero_copy_only=False).astype(np.int64)
    # In the joined texts a word is followed by one space, the last word of a text by nothing.
    last = np.zeros(len(sizes), np.int64)
    last[found.starts[1:][counts > 0] - 1] = 1
    ends = np.cumsum(sizes + 1 - last) + last - 1
    begins = ends - sizes
    number = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    first = np.repeat(found.starts[:-1] - (np.cumsum(number) - number), number) + np.arange(number.sum())
    final = np.minimum(first + words, np.repeat(found.starts[1:], number)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[first].tolist(), ends[final].tolist())
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(first)), number


def majority_bits(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Fingerprints from consecutive runs of hashes; a run of none gives zero."""
    counts = np.zeros((len(number), 64), np.int64)
    owner = np.repeat(np.arange(len(number)), number)
    for at in range(0, len(hashes), UNPACKED):
        part = hashes[at : at + UNPACKED]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whose = owner[at : at + UNPACKED]
        cuts = np.concatenate([[0], np.nonzero(whose[1:] != whose[:-1])[0] + 1])
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
            counts[whose[begin]] += bits[begin:end].sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > number[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprinted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = majority_bits(*shingle_hashes(plain(batch.column("text")), words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "bits"])


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit plane k of 64-bit values, 64 values to a word, for each k."""
    padded = np.zeros(-(-len(values) // 64) * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, held in bit-sliced counters, is above ``radius``."""
    above, equal = over.copy(), ~over
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            above |= equal & counters[level]
            equal &= ~counters[level]
    return above


def close_pairs(values: np.ndarray, last: np.ndarray, radius: int, free: int = ALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j <= last[i], of values that differ in at most ``radius`` bits; only ``free`` bits can differ."""
    planes = planes_of(values)
    used = [k for k in range(64) if free >> k & 1]
    place = np.arange(len(values))
    words = np.where(last > place, (last >> 6) - ((place + 1) >> 6) + 1, 0)
    until = np.cumsum(words)
    one, whole = np.uint64(1), np.uint64(ALL)
    for base in range(0, int(until[-1]) if len(until) else 0, BLOCKS):
        number = np.arange(base, min(base + BLOCKS, int(until[-1])))
        i = np.searchsorted(until, number, side="right")
        word = ((i + 1) >> 6) + number - (until[i] - words[i])
        low = np.maximum(i + 1 - 64 * word, 0).astype(np.uint64)
        high = np.minimum(last[i] - 64 * word, 63).astype(np.uint64)
        lanes = (whole << low) & (whole >> (np.uint64(63) - high))
        counters = [np.zeros(len(i), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(len(i), np.uint64)
        own = values[i]
        for turn, k in enumerate(used, 1):
            carry = planes[k][word] ^ (np.uint64(0) - ((own >> np.uint64(k)) & one))
            for level, held in enumerate(counters):
                counters[level], carry = held ^ carry, held & carry
            over |= carry
            if turn % PATIENCE == 0 or turn == len(used):
                lanes = lanes & ~_exceeds(counters, over, radius)
                alive = lanes != 0
                if not alive.all():
                    i, word, own, lanes, over = i[alive], word[alive], own[alive], lanes[alive], over[alive]
                    counters = [c[alive] for c in counters]
            if not len(i):
                break
        at, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        if len(at):
            yield i[at], 64 * word[at] + lane


def _joined(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each place reaches, after links (i, j) are added."""
    while True:
        apart = roots[i] != roots[j]
        if not apart.any():
            return roots
        i, j = i[apart], j[apart]
        a, b = roots[i], roots[j]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = roots[roots]
            if (further == roots).all():
                break
            roots = further


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links that join members of a bucket; rows come sorted by bucket, and buckets are of bounded size."""

    def flushed(mask: np.ndarray, prefix: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        change = np.nonzero((mask[1:] != mask[:-1]) | (prefix[1:] != prefix[:-1]))[0]
        ends = np.concatenate([change, [len(bits) - 1]])
        last = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
        free = ALL & ~int(np.bitwise_and.reduce(mask.view(np.uint64)))
        roots = np.arange(len(bits))
        for i, j in close_pairs(bits.view(np.uint64), last, radius, free):
            roots = _joined(roots, i, j)
        linked = np.nonzero(roots != np.arange(len(bits)))[0]
        return pa.RecordBatch.from_arrays([pa.array(bits[linked]), pa.array(bits[roots[linked]])], ["u", "v"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("mask", "prefix", "bits"))]
        if len(held[0]) < TOGETHER:
            continue
        # The last bucket may go on in the next batch.
        mask, prefix, _ = held
        change = np.nonzero((mask[1:] != mask[:-1]) | (prefix[1:] != prefix[:-1]))[0]
        if len(change):
            cut = int(change[-1]) + 1
            yield flushed(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield flushed(*held)
    pa.default_memory_pool().release_unused()


def refined(mask: int, radius: int) -> list[int]:
    """Masks that fix two further parts of the bits that ``mask`` leaves free."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * p // (radius + 2) for p in range(radius + 3)]
    parts = [sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [mask | a | b for a, b in combinations(parts, 2)]


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) that connect what pairs of distinct ``bits`` within ``radius`` connect."""
    if limit < 1 << (radius + 2):
        raise ValueError("buckets whose parts have one bit each must be within the limit")
    spark = nodes.sparkSession
    found: list[DataFrame] = []
    rows, masks = nodes.select(F.lit(0).cast("long").alias("mask"), "bits"), [0]
    while True:
        # At most 1, 6, 36, ... masks, each with 6 further ones.
        steps = [(F.lit(_signed(m)), F.array(*[F.lit(_signed(further)) for further in refined(m, radius)])) for m in masks]
        cut = rows.select(F.explode(F.element_at(F.create_map(*[x for step in steps for x in step]), F.col("mask"))).alias("mask"), "bits")
        keyed = cut.select("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("prefix"), "bits")
        large = stored(keyed.groupBy("mask", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n"), "simhash-large")
        more = not large.isEmpty()
        if more:
            salted = keyed.withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(64)))
            spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
            on = ["mask", "prefix", "salt"]
            keyed = salted.join(spread, on, "left_anti").drop("salt")
            rows = stored(salted.join(spread, on, "left_semi").select("mask", "bits").distinct(), "simhash-split")
            masks = sorted(r.mask & ALL for r in large.select("mask").distinct().collect())
        dealt = keyed.repartition(shuffle_parts(spark), "mask", "prefix").sortWithinPartitions("mask", "prefix", "bits")
        found.append(stored(dealt.mapInArrow(lambda batches: _links(batches, radius), "u long, v long").distinct(), "simhash-links"))
        if not more:
            break
    return reduce(DataFrame.union, found)


def simhash_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits) and component_id.

    Shingles are runs of ``words`` words (A to Z in lower case, repeats included; a text of fewer words is one shingle).
    A text that is null or has no words has the fingerprint zero and is linked like any other. Texts whose fingerprints
    differ in at most ``radius`` bits are linked; ``component_id`` is the smallest id that links reach, the row's own
    included. Every row is a text of its own: rows that share an id are linked only if their fingerprints are close,
    and a row without id counts with its text but gives no id (null where no id is reached). Ids are integers. Other
    columns are neither looked at nor returned. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(source.mapInArrow(lambda batches: _fingerprinted(batches, words), "doc_id long, bits long"), "simhash-bits")
    nodes = stored(signed.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("bits"), radius), "simhash-components").select(F.col("node").alias("bits"), "root")
    placed = nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("bits", "root").join(least, "root").select("bits", "component_id")
    return signed.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
