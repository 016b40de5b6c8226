"""Document fingerprints: MinHash under many universal hash permutations, computed in vectorised numpy.

A fingerprint is, for each of ``PERMUTATIONS`` functions x -> (a x + b mod 2^64) / 2^32, the least value over the hashes
of a text's word shingles. Equal positions of two fingerprints estimate the Jaccard similarity of their shingles.
``edited_fingerprints`` also fingerprints each text with its end replaced by the start of the next document, and hashes
only what the edit changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import NO_ID, UPPER, discard, hashes, mixed, plain, rolled, ship, shuffle_parts, slices, stored, words_of
from .near_dup import confirmed

PERMUTATIONS = 64
#: Rows of a band: 21 bands of 3 miss a pair at a similarity of 0.8 with a probability below 1e-6.
ROWS = 3
WORDS = 5
_EMPTY = np.uint32(0xFFFFFFFF)
_A = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) << np.uint64(32))


def least_values(shingles: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Least value of every permutation over each segment of ``shingles``; empty segments have the largest value."""
    out = np.full((len(starts), PERMUTATIONS), _EMPTY, np.uint32)
    full = np.nonzero(stops > starts)[0]
    if not len(full):
        return out
    # Segments as reduceat takes them: even bounds begin a segment, odd ones what lies between.
    bounds = np.stack([starts[full], stops[full]], axis=1).reshape(-1)
    values = np.append(shingles, np.uint64(0))
    buffer = np.empty_like(values)
    for k in range(PERMUTATIONS):
        np.multiply(values, _A[k], out=buffer)
        np.add(buffer, _B[k], out=buffer)
        out[full, k] = (np.minimum.reduceat(buffer, bounds)[::2] >> np.uint64(32)).astype(np.uint32)
    return out


def _short(values: np.ndarray) -> np.ndarray:
    """A text of fewer words than a shingle has is one shingle."""
    return np.array([xxhash.xxh64_intdigest(values.tobytes(), len(values))] if len(values) else [], np.uint64)


def signatures(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """A row of least values for each text."""
    found = words_of(texts)
    codes, distinct = found.coded()
    values = hashes(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)
    runs = rolled(values, words)
    short = [_short(values[a:b]) if b - a < words else None for a, b in zip(found.starts[:-1].tolist(), found.starts[1:].tolist())]
    extra = np.concatenate([s for s in short if s is not None] or [np.zeros(0, np.uint64)])
    sizes = np.array([-1 if s is None else len(s) for s in short], np.int64)
    place = len(runs) + np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    starts = np.where(sizes < 0, found.starts[:-1], place)
    stops = np.where(sizes < 0, found.starts[1:] - words + 1, place + sizes)
    return least_values(np.concatenate([runs, extra]), starts, stops)


def _hex(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows.astype(">u4")]


def _last_space(text: str) -> int:
    return max(text.rfind(c) for c in " \t\n\x0b\x0c\r")


class _Prepared:
    """Signatures of a slice of texts and of their edited forms, sharing what both have."""

    def __init__(self, texts: list[str], following: list[str | None], words: int):
        edited, cut, heads, tails = [], [], [], []
        for text, after in zip(texts, following):
            if after is None:
                edited.append(None)
                cut.append(0)
                heads.append(0)
                tails.append("")
                continue
            keep = len(text) - len(text) // 4
            new = text[:keep] + after[: len(text) // 4]
            safe = _last_space(text[:keep]) + 1
            edited.append(new)
            cut.append(safe)
            heads.append(len(text[:safe].encode().split()))
            tails.append(new[safe:])
        self.edited = edited
        n = len(texts)
        found = words_of(pa.array([*texts, *tails], pa.string()))
        codes, distinct = found.coded()
        values = hashes(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)
        runs = rolled(values, words)
        begin, stop = found.starts[:n], found.starts[1 : n + 1]
        head = np.array(heads, np.int64)
        # Shingles that lie wholly in the unchanged words, the rest of the text's own, and the edited text's own.
        count = np.maximum(stop - begin - words + 1, 0)
        shared = np.minimum(np.maximum(head - words + 1, 0), count)
        own, new_runs = [], []
        for i in range(n):
            a, b = int(begin[i]), int(stop[i])
            own.append(_short(values[a:b]) if b - a < words else None)
            if edited[i] is None:
                new_runs.append(np.zeros(0, np.uint64))
                continue
            lead = values[a + max(0, heads[i] - words + 1) : a + heads[i]]
            rest = values[found.starts[n + i] : found.starts[n + i + 1]]
            both = np.concatenate([lead, rest])
            whole = heads[i] + len(rest)
            new_runs.append(rolled(both, words) if whole >= words else _short(np.concatenate([values[a : a + heads[i]], rest])))
        pieces = [runs, *(o for o in own if o is not None), *new_runs]
        everything = np.concatenate(pieces)
        own_size = np.array([-1 if o is None else len(o) for o in own], np.int64)
        own_at = len(runs) + np.cumsum(np.maximum(own_size, 0)) - np.maximum(own_size, 0)
        sizes = np.array([len(r) for r in new_runs], np.int64)
        new_at = len(runs) + int(np.maximum(own_size, 0).sum()) + np.cumsum(sizes) - sizes
        first = least_values(everything, begin, begin + shared)
        second = least_values(everything, np.where(own_size < 0, begin + shared, own_at), np.where(own_size < 0, begin + count, own_at + own_size))
        third = least_values(everything, new_at, new_at + sizes)
        self.plain = np.minimum(first, second)
        self.changed = np.minimum(first, third)


def _fingerprinted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, tail, id): each document with the one behind it; tails are there to be looked at only."""
    held: tuple | None = None
    for batch in slices(batches):
        rows = list(zip(batch.column("part").to_pylist(), batch.column("tail").to_pylist(), batch.column("id").to_pylist(), plain(batch.column("text")).to_pylist()))
        if held is not None:
            rows.insert(0, held)
        yield from _emitted(rows, words)
        held = rows[-1]


def _emitted(rows: list[tuple], words: int) -> Iterator[pa.RecordBatch]:
    # The last row waits for the slice with its successor; it is a tail where nothing follows.
    following = [b[3] if a[0] == b[0] and not a[1] else None for a, b in zip(rows, rows[1:])] + [None]
    made = _Prepared([r[3] for r in rows], following, words)
    at = [i for i, after in enumerate(following) if after is not None]
    plain_rows, changed = made.plain, made.changed
    nearer = (plain_rows[at] == changed[at]).mean(axis=1) if at else np.zeros(0)
    nexts = (plain_rows[at] == plain_rows[[i + 1 for i in at]]).mean(axis=1) if at else np.zeros(0)
    prints, edits = _hex(plain_rows[at]) if at else [], _hex(changed[at]) if at else []
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in at], pa.int64()),
            pa.array([len(rows[i][3]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(made.edited[i].encode()).hexdigest() for i in at], pa.string()),
            pa.array(prints, pa.string()),
            pa.array(edits, pa.string()),
            pa.array(nearer, pa.float64()),
            pa.array(nexts, pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points (rounded down) replaced by the first as many, or all, of
    the next document in ascending doc_id order, for the last one of the first. Fingerprints are over shingles of
    ``words`` words (runs of anything but white space; fewer words are one shingle); texts without words, null ones
    too, have the fingerprint of the empty set. A null doc_id comes first; rows with one doc_id come in the order of a
    hash of their texts. A single document is its own next. Other columns are not looked at.

    Documents are dealt to ranges of ids that start at ids from the table, so each range needs one more row, the first
    of the next; texts are shuffled once and no range depends on another.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    parts = shuffle_parts(spark)
    cuts = F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts) if parts > 1 else F.array().cast("array<long>")
    least, cuts = source.agg(F.min("id"), cuts).first()
    bounds = sorted({b for b in cuts or [] if b != least})
    known = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    part = F.size(F.filter(known, lambda b: b <= F.col("id")))
    place = lambda p, tail: F.struct(p.cast("int").alias("part"), F.lit(tail).alias("tail"))
    places = F.concat(
        F.array(place(part, False)),
        F.when(F.array_contains(known, F.col("id")), F.array(place(part - 1, True))).otherwise(F.array().cast("array<struct<part:int,tail:boolean>>")),
        F.when(F.col("id") == (NO_ID if least is None else least), F.array(place(F.lit(len(bounds)), True))).otherwise(
            F.array().cast("array<struct<part:int,tail:boolean>>")
        ),
    )
    dealt = source.select("id", "text", F.explode(places).alias("at")).select("at.part", "at.tail", "id", "text")
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "tail", "id", F.xxhash64("text"))
    made = ordered.mapInArrow(
        lambda batches: _fingerprinted(batches, words),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _signed(batches: Iterator[pa.RecordBatch], words: int, printed: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = signatures(plain(batch.column("text")), words)
        bands = PERMUTATIONS // ROWS
        cut = rows[:, : bands * ROWS].reshape(len(rows), bands, ROWS).astype(np.uint64)
        keys = np.zeros((len(rows), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
        for r in range(ROWS):
            keys = mixed(keys + cut[:, :, r])
        empty = (rows == _EMPTY).all(axis=1)
        # A fingerprint is no proof of equal texts: the digest that makes classes is the text's own.
        texts = pc.ascii_lower(plain(batch.column("text"))).cast(pa.binary()).to_pylist()
        digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(text), np.int64) for text in texts]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array((~empty).astype(np.int64)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                pa.array([[] if e else row for e, row in zip(empty.tolist(), keys.view(np.int64))], pa.list_(pa.int64())),
                *([pa.array(_hex(rows), pa.string())] if printed else []),
            ],
            ["id", "n", "d1", "d2", "bands", *(["fingerprint"] if printed else [])],
        )


def _similarity(docs: DataFrame, words: int, percent: int, printed: bool) -> tuple[DataFrame, DataFrame]:
    """Per row id and what :func:`confirmed` wants, with fingerprints if ``printed``; and (node, root) of the classes,
    without nodes that are their own root."""
    ship(docs.sparkSession)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.translate("text", UPPER, UPPER.lower()).alias("text"))
    schema = "id long, n long, d1 long, d2 long, bands array<long>" + (", fingerprint string" if printed else "")
    signed = stored(source.mapInArrow(lambda batches: _signed(batches, words, printed), schema), "fingerprints")
    return signed, confirmed(docs.select("doc_id", "text"), signed.drop("fingerprint"), words, percent)


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint and class_id, the smallest id it is similar to, itself or
    through others.

    Texts that share a band of ``ROWS`` positions of their fingerprints are candidates; what counts is the Jaccard
    similarity of their full sets of shingles (A to Z in lower case), ``percent`` or more. Texts with one fingerprint
    are candidates of each other too. Nulls, empty texts and repeated ids are taken as by near_duplicates.
    """
    # Rows that share an id are one node and get one class; each keeps its own fingerprint.
    rows, roots = _similarity(docs, words, percent, True)
    return _classed(rows.select("id", "fingerprint"), "id", roots).select(_given("id").alias("doc_id"), "fingerprint", "class_id")


def _given(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def _classed(rows: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """``rows`` with the class_id of their ``node``; roots have each node once, so no row meets two."""
    joined = rows.join(roots.withColumnRenamed("node", "_node"), F.col(node) == F.col("_node"), "left")
    return joined.withColumn("root", F.coalesce("root", node)).withColumn("class_id", _given("root")).drop("_node", "root")


def fingerprints_and_classes(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """:func:`edited_fingerprints` with the class_id of :func:`similar_documents`, one row for each of ``docs``."""
    signed, roots = _similarity(docs, words, percent, False)
    discard(signed)
    found = edited_fingerprints(docs, words).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    return _classed(found, "_id", roots).drop("_id")
