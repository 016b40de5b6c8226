"""Removing repeated passages of words, by super-k-mer partitioning.

Windows are ``width`` consecutive words. A window's minimiser is the least hash of its ``MINIMISER``-word pieces;
consecutive windows with the same one travel as one packed string to the minimiser's bucket, and so do all other
occurrences of these windows. There the windows of all distinct strings are sorted, so equal ones stand together and
all but the earliest are known to repeat. Strings whose minimiser nothing else in the bucket has are left out at once.
A phrase that stands in many places with different surroundings would fill one bucket as a minimiser; a first reading
finds such phrases, and windows go by their other pieces (see ``superkmers``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import NO_ID, STEP, Words, discard, extended, hashes, ids_of, mixed, nested, plain, rolled, ship, shuffle_parts, slices, stored, words_of
from .near_dup import grouped
from .superkmers import DEALT, SPANS, TALLY, Packed, Pieces, chosen, covered, dealt, decode, decode_spans, first_of_equal, inner_repeats, merged, not_alone, runs_of, span_batch, tallied

MINIMISER = 4
#: A minimiser is late if it has this share of a partition's strings, and so many in a task that the share means something.
SHARE, AT_LEAST = 0.5, 64
#: Strings in a bucket at most, on average; a partition has as many buckets as that takes.
BUCKET_STRINGS = 1 << 20


def longer_piece(width: int, piece: int) -> int:
    """Length of the pieces that windows of late pieces go by."""
    return max(piece, width * 3 // 5)


class _Words(NamedTuple):
    """A slice of documents in words, and its pieces."""

    batch: pa.RecordBatch
    words: Words
    pieces: Pieces

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Words]:
        for batch in slices(batches):
            words = words_of(plain(batch.column("text")))
            codes, distinct = words.coded()
            if len(codes) < width:
                continue
            values, long = hashes(distinct)[codes], longer_piece(width, MINIMISER)
            counts = np.maximum(words.counts - width + 1, 0)
            base = np.repeat(words.starts[:-1], counts)
            valid = base + np.arange(len(base)) - np.repeat(np.cumsum(counts) - counts, counts)
            pieces = Pieces(rolled(values, MINIMISER), width - MINIMISER + 1, lambda v=values: rolled(v, long), width - long + 1, valid)
            yield _Words(batch, words, pieces)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Pieces]:
    return (held.pieces for held in _Words.of(batches, width))


def _packed(batches: Iterator[pa.RecordBatch], width: int, buckets: int, late: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, words, pieces in _Words.of(batches, width):
        cut = runs_of(pieces, late)
        starts, windows = cut.starts, cut.windows
        owner = np.searchsorted(words.starts, starts, side="right") - 1
        text = words.joined()
        buffer = text.buffers()[2].to_pybytes() if text.buffers()[2] else b""
        offsets = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1].astype(np.int64)
        ends = np.cumsum(pc.binary_length(words.flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begins = np.concatenate([[0], ends[:-1]])
        # Within its joined text each word is followed by a space, but for the last.
        shift = offsets[owner] - begins[words.starts[owner]]
        lo = begins[starts] + shift
        hi = ends[starts + windows + width - 2] - 1 + shift
        texts = [buffer[s:e] for s, e in zip(lo.tolist(), hi.tolist())]
        yield dealt(
            ids_of(batch.column("doc_id")), batch.column("mark").to_numpy(zero_copy_only=False), owner, starts - words.starts[owner], windows, cut.least,
            inner_repeats(cut, pieces.reach), texts, width, buckets,
        )


def word_windows(part: Packed, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of distinct strings: string number, offset in it, and a class number that equal windows share."""
    words = words_of(pa.array(part.text, pa.binary()).cast(pa.string()))
    codes = words.coded()[0].astype(np.int64)
    counts = words.counts - width + 1
    string = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = words.starts[string] + offset
    sums = np.zeros(len(at), np.uint64)
    for j in range(width):
        sums = sums * STEP + mixed(codes[at + j].astype(np.uint64))
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    # Equal sums are a guess; the words decide.
    if all((codes[at[order] + j] == codes[at[head] + j]).all() for j in range(width)):
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new)
    else:
        rows = np.stack([codes[at + j] for j in range(width)], axis=1)
        number = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    return string, offset, number


def repeated(part: Packed, width: int, classes: Callable) -> Iterator[pa.RecordBatch]:
    """Spans of one bucket whose windows start earlier elsewhere."""
    if not len(part.key):
        return
    distinct, later, _ = first_of_equal(part)
    if len(later):
        yield span_batch(part.id[later], part.mark[later], part.start[later].astype(np.int64), part.start[later].astype(np.int64) + part.windows[later] + width - 1)
    _, code, times = np.unique(distinct.key, return_inverse=True, return_counts=True)
    distinct = chosen(distinct, (times[code] > 1) | (distinct.inner > 0))
    if not len(distinct.key):
        return
    string, offset, number = classes(distinct, width)
    ids, marks, starts = distinct.id[string], distinct.mark[string], distinct.start[string].astype(np.int64) + offset
    order = np.lexsort((starts, marks, ids, number))
    n, i, m, s = number[order], ids[order], marks[order], starts[order]
    first = np.ones(len(order), bool)
    first[1:] = n[1:] != n[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    drop = (i != i[head]) | (m != m[head]) | (s != s[head])
    if drop.any():
        yield merged(i[drop], m[drop], s[drop], width)


def compared(batches: Iterator[pa.RecordBatch], width: int, classes: Callable) -> Iterator[pa.RecordBatch]:
    """Bucket after bucket of one partition, sorted by bucket."""
    for group in grouped(batches, ["bucket"]):
        parts = []
        for kind, payload in zip(group["kind"].to_pylist(), group["payload"].to_pylist()):
            if kind == 1:
                yield span_batch(*decode_spans(payload))
            else:
                parts.append(decode(payload))
        if parts:
            yield from repeated(not_alone(parts), width, classes)


class Method(NamedTuple):
    """What windows are made of: pieces of slices, super-k-mers of slices, and classes of the windows of strings."""

    pieces: Callable
    packed: Callable
    classes: Callable


def _late_pieces(docs: DataFrame, method: Method, width: int, parts: int) -> tuple[np.ndarray, int]:
    """Pieces that come last, and the number of strings.

    One reading of all texts counts strings by minimiser in each task; what comes back are the pieces with the share of
    a partition's strings, of which there are so many at most as the share allows for each partition.
    """
    share, at_least = SHARE / parts, AT_LEAST
    tallies = stored(docs.select("text").mapInArrow(lambda batches: tallied(method.pieces(batches, width), share, at_least), TALLY), "tallies")
    total = tallies.where("piece is null").agg(F.sum("n")).first()[0] or 0
    counted = tallies.where("piece is not null").groupBy("piece").agg(F.sum("n").alias("n"))
    late = [r.piece for r in counted.where(F.col("n") >= max(at_least, share * total)).collect()]
    discard(tallies)
    return np.sort(np.array(late, np.int64).view(np.uint64)), total


def spans_to_remove(docs: DataFrame, method: Method, width: int) -> DataFrame:
    """(id, mark, spans) of every document that loses something; ``docs`` has doc_id, mark and text."""
    spark = docs.sparkSession
    ship(spark)
    parts = shuffle_parts(spark)
    late, strings = _late_pieces(docs, method, width, parts)
    buckets = parts * max(1, -(-strings // (parts * BUCKET_STRINGS)))
    sent = docs.mapInArrow(lambda batches: method.packed(batches, width, buckets, late), DEALT)
    lying = sent.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    found = lying.mapInArrow(lambda batches: compared(batches, width, method.classes), SPANS)
    return found.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def with_spans(docs: DataFrame, method: Method, width: int) -> DataFrame:
    """``docs`` and the spans that each row loses (null for none), on column ``spans``."""
    # What tells rows with one id apart need not travel where ids are unique.
    rows, ids = docs.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))).first()
    mark = F.lit(0).cast("long") if rows == ids else F.coalesce(F.xxhash64("text"), F.lit(0))
    keyed = docs.withColumn("mark", mark)
    spans = spans_to_remove(keyed.select("doc_id", "mark", "text"), method, width)
    spans = spans.withColumnRenamed("mark", "_mark")
    on = (F.coalesce(keyed["doc_id"].cast("long"), F.lit(NO_ID)) == spans["id"]) & (keyed["mark"] == spans["_mark"])
    return keyed.join(spans.hint("shuffle_hash"), on, "left").drop("id", "_mark", "mark")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = plain(batch.column("text"))
        n_words, removed, digest, kept = [], [], [], []
        for text, spans in zip(texts.cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            words = text.split()
            n_words.append(len(words))
            rest = words
            if spans:
                gone = covered(len(words), [s["start"] for s in spans], [s["stop"] for s in spans])
                rest = [w for w, g in zip(words, gone.tolist()) if not g]
            removed.append(len(words) - len(rest))
            whole = b" ".join(rest)
            digest.append(hashlib.sha256(whole).hexdigest())
            kept.append((whole if spans else text).decode())
        columns = {name: batch.column(name) for name in batch.schema.names if name not in ("spans", "n_words", "n_removed", "kept_sha256", "kept_text")}
        columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept_text": pa.array(kept, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text.

    A word goes if a window of ``width`` words that covers it also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. All windows are judged on the texts as they came. ``kept_text`` is the text
    itself where nothing goes, else the kept words with one space between them; ``kept_sha256`` is of the kept words
    joined by one space. Null and empty texts have no words. A null doc_id comes before all others; rows with one
    doc_id but different texts come in the order of a hash of their texts; a row repeated whole is one document, and
    each of its rows gets the same result. Columns with the names of results are replaced, all others stay.
    """
    results = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    held, back = nested(docs, results)
    schema = extended(held, "n_words long, n_removed long, kept_sha256 string, kept_text string")
    return with_spans(held, Method(_pieces, _packed, word_windows), width).mapInArrow(_kept, schema).select(*back, *results)
