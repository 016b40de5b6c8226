"""Removing repeated byte strings with suffix arrays.

Windows of ``width`` bytes go as super-k-mers to the bucket of their minimiser, so every occurrence of a window lies in
one bucket and no text is sorted whole on one machine. In a bucket, stretches of distinct strings whose windows have a
hash that others have too are sorted by suffix; equal windows then stand together, and all but the earliest repeat.

The suffix array is built by linear grouping. First, suffixes are put into groups by their first byte, and the groups
are processed from the last to the first. For each suffix of the group, the pointer to the previous suffix of a smaller
group says whose Lyndon prefix the group's own extends; those suffixes leave their group for a new one right behind it,
the further the more often they are extended. In the end each group has one Lyndon prefix. Second, the order within
groups follows from the suffixes in ascending order: each one gives the next place in its group to those in front of
it, along the same pointers, that have none yet. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import STEP, extended, ids_of, mixed, nested, plain, slices
from .superkmers import Packed, Pieces, covered, dealt, inner_repeats, runs_of
from .window_dedup import Method, longer_piece, with_spans

#: Bytes in a minimiser.
MINIMISER = 16
#: Strings of so many bytes together are looked through and sorted at a time; those of one minimiser are never parted.
COMPARED_BYTES, SORTED_BYTES = 1 << 20, 1 << 18


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a suffix comes before those that it begins."""
    n = len(text) + 1  # with an end that is smaller than any byte
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    firsts = (np.cumsum(counts) - counts + 1).tolist()
    label = [firsts[b] for b in text]
    label.append(0)
    members: dict[int, list[int]] = {0: [n - 1]}
    order = np.argsort(np.frombuffer(text, np.uint8), kind="stable").tolist()
    head_of = [0] * n  # for the last place of each group, its first
    for byte in np.nonzero(counts)[0].tolist():
        first, size = firsts[byte], int(counts[byte])
        members[first] = order[first - 1 : first - 1 + size]
        head_of[first + size - 1] = first
    tail_of = {members_first: members_first + len(own) - 1 for members_first, own in members.items()}
    previous = [-1] * n

    end = n - 1
    while end > 0:
        first = head_of[end]
        own = [s for s in members.pop(first) if label[s] == first]
        own.sort()
        extended: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and label[p] >= first:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                extended[p] = extended.get(p, 0) + 1
        end = first - 1
        moved: dict[int, dict[int, list[int]]] = {}
        for p, times in extended.items():
            old = label[p]
            by_times = moved.get(old)
            if by_times is None:
                moved[old] = {times: [p]}
            elif times in by_times:
                by_times[times].append(p)
            else:
                by_times[times] = [p]
        for old, by_times in moved.items():
            tail = tail_of[old]
            for times in sorted(by_times, reverse=True) if len(by_times) > 1 else by_times:
                group = by_times[times]
                start = tail - len(group) + 1
                if start == old:
                    break
                members[start] = group
                for p in group:
                    label[p] = start
                head_of[tail] = start
                tail_of[start] = tail
                tail = start - 1
            head_of[tail] = old
            tail_of[old] = tail

    array = [-1] * n
    array[0] = n - 1
    free = dict.fromkeys(label)  # by first place of a group: the next place in it
    for first in free:
        free[first] = first
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        p = array[i] - 1
        while p >= 0 and not placed[p]:
            place = free[label[p]]
            free[label[p]] = place + 1
            array[place] = p
            placed[p] = 1
            p = previous[p]
    return array[1:]


def _loads(data: bytes) -> np.ndarray:
    """The eight bytes from each place as a number."""
    n = len(data) - 7
    out = np.empty(max(0, n), np.uint64)
    for shift in range(8):
        own = np.frombuffer(data, np.uint64, (len(data) - shift) // 8, shift)
        out[shift::8] = own[: len(out[shift::8])]
    return out


def _sorted_classes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and class of each window of some strings, from their suffix array."""
    data = b"".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    array = np.array(suffix_array(data), np.int64)
    string = np.searchsorted(begins, array, side="right") - 1
    offset = array - begins[string]
    inside = offset <= lengths[string] - width
    array, string, offset = array[inside], string[inside], offset[inside]
    eight = _loads(data)
    equal = np.ones(max(0, len(array) - 1), bool)
    for shift in [*range(0, width - 7, 8), width - 8]:
        equal &= eight[array[1:] + shift] == eight[array[:-1] + shift]
    return string, offset, np.concatenate([[0], np.cumsum(~equal)])[: len(array)]


def _candidates(texts: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """(string, start, stop) of the stretches whose every window has a hash that another window has too.

    Equal windows have equal hashes, so all else can be left out of the sorting.
    """
    data = b"".join(texts)
    eight = _loads(data)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - width + 1, 0)
    firsts = np.cumsum(counts) - counts
    at = np.repeat(begins - firsts, counts) + np.arange(int(counts.sum()))
    sums = np.zeros(len(at), np.uint64)
    for shift in [*range(0, width - 7, 8), width - 8]:
        sums = sums * STEP + eight[at + shift]
    sums = mixed(sums)
    order = np.argsort(sums, kind="stable")
    equal = sums[order[1:]] == sums[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    string = np.repeat(np.arange(len(texts)), counts)
    offset = at - begins[string]
    kept = np.nonzero(again)[0]
    if not len(kept):
        return []
    string, offset = string[kept], offset[kept]
    cut = np.ones(len(kept), bool)
    cut[1:] = (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)
    heads = np.nonzero(cut)[0]
    tails = np.append(heads[1:], len(kept)) - 1
    return list(zip(string[heads].tolist(), offset[heads].tolist(), (offset[tails] + width).tolist()))


def byte_windows(part: Packed, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of distinct strings: string number, offset in it, and a class number that equal windows share."""
    none = np.zeros(0, np.int64)
    found, base = [(none, none, none)], 0
    order = np.argsort(part.key, kind="stable").tolist()
    for held in _batched(order, part.key[order], [len(part.text[i]) for i in order], COMPARED_BYTES):
        spans = [(held[string], start, stop) for string, start, stop in _candidates([part.text[i] for i in held], width)]
        for some in _batched(spans, part.key[[i for i, _, _ in spans]], [stop - start for _, start, stop in spans], SORTED_BYTES):
            string, offset, number = _sorted_classes([part.text[i][start:stop] for i, start, stop in some], width)
            at = np.array(some, np.int64)
            found.append((at[string, 0], at[string, 1] + offset, number + base))
            base += int(number.max()) + 1 if len(number) else 0
    return tuple(np.concatenate(c) for c in zip(*found))


def _batched(items: list, keys: np.ndarray, sizes: list[int], limit: int) -> Iterator[list]:
    """``items`` in runs of about ``limit`` bytes; those with one key, which stand together, are never parted."""
    start, size = 0, 0
    for i in range(len(items)):
        if size > limit and keys[i] != keys[i - 1]:
            yield items[start:i]
            start, size = i, 0
        size += sizes[i]
    if start < len(items):
        yield items[start:]


class _Bytes(NamedTuple):
    """A slice of documents as bytes, where each begins, and its pieces."""

    batch: pa.RecordBatch
    data: bytes
    offsets: np.ndarray
    pieces: Pieces

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Bytes]:
        for batch in slices(batches, limit=4 << 20):
            texts = plain(batch.column("text"))
            data = texts.buffers()[2]
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data else b""
            offsets -= offsets[0]
            if len(data) < width:
                continue
            eight, long = _loads(data), longer_piece(width, MINIMISER)
            counts = np.maximum(np.diff(offsets) - width + 1, 0)
            valid = np.repeat(offsets[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            pieces = Pieces(_runs_of_bytes(eight, MINIMISER), width - MINIMISER + 1, lambda e=eight: _runs_of_bytes(e, long), width - long + 1, valid)
            yield _Bytes(batch, data, offsets, pieces)


def _runs_of_bytes(eight: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` bytes, from the eight bytes at each place."""
    n = max(0, len(eight) + 8 - length)
    sums = np.zeros(n, np.uint64)
    for shift in [*range(0, length - 7, 8), length - 8]:
        sums = sums * STEP + eight[shift : shift + n]
    return mixed(sums)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Pieces]:
    return (held.pieces for held in _Bytes.of(batches, width))


def _packed(batches: Iterator[pa.RecordBatch], width: int, buckets: int, late: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets, pieces in _Bytes.of(batches, width):
        cut = runs_of(pieces, late)
        starts, windows = cut.starts, cut.windows
        owner = np.searchsorted(offsets, starts, side="right") - 1
        strings = [data[s:e] for s, e in zip(starts.tolist(), (starts + windows + width - 1).tolist())]
        yield dealt(
            ids_of(batch.column("doc_id")), batch.column("mark").to_numpy(zero_copy_only=False), owner, starts - offsets[owner], windows, cut.least,
            inner_repeats(cut, pieces.reach), strings, width, buckets,
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = plain(batch.column("text"))
        n_bytes, removed, n_spans, digest, kept = [], [], [], [], []
        for text, spans in zip(texts.cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            rest, count = text, 0
            if spans:
                gone = covered(len(text), [s["start"] for s in spans], [s["stop"] for s in spans])
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                count = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
            n_bytes.append(len(text))
            removed.append(len(text) - len(rest))
            n_spans.append(count)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        results = {
            "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary()),
        }
        columns = {name: batch.column(name) for name in batch.schema.names if name not in ("spans", *results)} | results
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def remove_repeated_bytes(docs: DataFrame, width: int = 100) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept (binary).

    A byte of the UTF-8 text goes if a string of ``width`` bytes (20 at least) that covers it also starts earlier: in a
    document with a smaller doc_id, or earlier in the same one. All strings are judged on the texts as they came, and
    none crosses documents. ``n_spans`` counts the maximal removed runs. Null is the empty text. A null doc_id comes
    before all others; rows with one doc_id but different texts come in the order of a hash of their texts; a row
    repeated whole is one document, and each of its rows gets the same result. Columns with the names of results are
    replaced, all others stay. What is kept may be cut inside a character, hence binary.
    """
    if width < MINIMISER + 4:
        raise ValueError(f"width must be {MINIMISER + 4} at least")
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    held, back = nested(docs, results)
    schema = extended(held, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return with_spans(held, Method(_pieces, _packed, byte_windows), width).mapInArrow(_kept, schema).select(*back, *results)
