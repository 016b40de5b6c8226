"""Super-k-mers: consecutive windows that share a minimiser, packed as one string and dealt to the minimiser's bucket.

Shared by the two operators that remove repeated windows. Positions count symbols (words or bytes) in one text.
A row of the dealt table holds all super-k-mers that one slice of documents has for one bucket, compressed together.

Pieces are ordered by a hash, but those in ``late`` come after all others. A piece is put there if the windows that
choose it are so many different strings that they would fill a bucket by themselves: a window that has any other piece
then goes by that one, and a window of late pieces only goes by its least longer piece. The choice depends on nothing
but the window and ``late``, so equal windows still meet, whatever is in there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

from .batches import STEP, mixed

#: bucket, kind (windows to compare, or spans already known to repeat), payload.
DEALT = "bucket int, kind int, payload binary"
SPANS = "id long, mark long, start long, stop long"
#: Windows in one packed string at most; longer runs are cut, which changes nothing but the packing.
LONGEST = 512
#: Set in the order of late pieces, and in the longer pieces that stand in for them.
LATE = np.uint64(1 << 63)
#: Strings by minimiser, as counted in one task (null: all strings), and how many minimisers a task keeps in mind.
TALLY = "piece long, n long"
TALLIED = 1 << 18


def minimisers(values: np.ndarray, reach: int) -> np.ndarray:
    """Least of each ``reach`` consecutive values, by doubling."""
    least, width = values, 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    return least


def runs(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of valid windows with one minimiser; ``valid``: window positions, ascending."""
    if not len(valid):
        return valid, valid
    cut = np.ones(len(valid), bool)
    cut[1:] = (valid[1:] != valid[:-1] + 1) | (least[valid[1:]] != least[valid[:-1]])
    heads = np.nonzero(cut)[0]
    lengths = np.diff(np.append(heads, len(valid)))
    if len(lengths) and lengths.max() > LONGEST:
        pieces = -(-lengths // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lengths = np.minimum(np.repeat(lengths, pieces) - nth * LONGEST, LONGEST)
        heads = np.repeat(heads, pieces) + nth * LONGEST
    return valid[heads], lengths


class Pieces(NamedTuple):
    """Pieces of one slice: the hash of the piece that begins at each place, how many of them a window has, the same for
    longer pieces (made only if wanted), and where windows begin, ascending.
    """

    short: np.ndarray
    reach: int
    longer: Callable[[], np.ndarray]
    longer_reach: int
    valid: np.ndarray


class Runs(NamedTuple):
    """Super-k-mers of a slice: starts and windows, the minimiser of each, and the order of the pieces at each place."""

    starts: np.ndarray
    windows: np.ndarray
    least: np.ndarray
    order: np.ndarray


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are in ``few`` (ascending)."""
    out = np.zeros(len(values), bool)
    if len(few):
        # Most values are not, and need no search.
        seen = np.zeros(1 << 16, bool)
        seen[(few >> np.uint64(40)).astype(np.int64) & 0xFFFF] = True
        at = np.nonzero(seen[(values >> np.uint64(40)).astype(np.int64) & 0xFFFF])[0]
        out[at] = few[np.minimum(np.searchsorted(few, values[at]), len(few) - 1)] == values[at]
    return out


def runs_of(pieces: Pieces, late: np.ndarray) -> Runs:
    """Super-k-mers under the order in which ``late`` pieces (ascending, without the bit ``LATE``) come last."""
    order = pieces.short & ~LATE
    if len(late):
        order[_among(order, late)] |= LATE
    least = minimisers(order, pieces.reach)
    if len(late):
        only_late = least >= LATE
        if only_late.any():
            least[only_late] = minimisers(pieces.longer() | LATE, pieces.longer_reach)[only_late]
    starts, windows = runs(least, pieces.valid)
    return Runs(starts, windows, least[starts], order)


def _strings(cut: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers and how many strings of each travel; equal strings of a slice travel once."""
    code = mixed(cut.least * STEP + cut.windows.astype(np.uint64)) + cut.order[cut.starts]
    return np.unique(cut.least[np.unique(code, return_index=True)[1]], return_counts=True)


def tallied(slices_of_pieces: Iterable[Pieces], share: float, at_least: int) -> Iterator[pa.RecordBatch]:
    """One task's count of strings by minimiser, for those that may have ``share`` of all, and of all strings.

    A minimiser found to have so many is late from then on. What is counted after it are the pieces that take its place,
    so all frequent pieces of one passage are found in one reading.
    """
    keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    late = np.zeros(0, np.uint64)
    for pieces in slices_of_pieces:
        frequent = None
        while True:
            own, times = _strings(runs_of(pieces, late))
            merged_keys, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
            merged_counts = np.bincount(place, np.concatenate([counts, times]), len(merged_keys)).astype(np.int64)
            bound = max(at_least, share * (total + int(times.sum())))
            fresh = merged_keys[(merged_counts >= bound) & (merged_keys < LATE)]
            fresh = fresh[~_among(fresh, late)]
            if not len(fresh):
                break
            if frequent is None:
                # Where one piece is late, others of its passage are too frequent as well.
                frequent, often = np.unique(pieces.short & ~LATE, return_counts=True)
                frequent = frequent[often >= bound]
                fresh = np.union1d(fresh, frequent)
            late = np.union1d(late, fresh)
        total += int(times.sum())
        floor = 0
        while len(merged_keys) > TALLIED:
            floor += 1
            merged_keys, merged_counts = merged_keys[merged_counts > floor], merged_counts[merged_counts > floor]
        keys, counts = merged_keys, merged_counts
    if not total:
        return
    bound = max(1, int(share * total))
    some = (counts >= max(2, bound // 4)) & (keys < LATE) & ~_among(keys, late)
    names = np.concatenate([late, keys[some]]).view(np.int64)
    times = np.concatenate([np.full(len(late), bound + 1), counts[some]])
    yield pa.RecordBatch.from_arrays(
        [pa.array([*names.tolist(), None], pa.int64()), pa.array([*times.tolist(), total], pa.int64())], ["piece", "n"]
    )


def inner_repeats(cut: Runs, reach: int, step: int = 8192) -> np.ndarray:
    """Which runs hold their minimiser in more than one place, or may; only these can hold one window twice."""
    starts, windows = cut.starts, cut.windows
    out = np.zeros(len(starts), bool)
    for at in range(0, len(starts), step):
        lengths = windows[at : at + step] + reach - 1
        ends = np.cumsum(lengths)
        place = np.repeat(starts[at : at + step] - (ends - lengths), lengths) + np.arange(ends[-1])
        equal = cut.order[place] == np.repeat(cut.least[at : at + step], lengths)
        out[at : at + step] = np.add.reduceat(equal, ends - lengths, dtype=np.int64) > 1
    return out | (cut.least >= LATE)


class Packed(NamedTuple):
    """Super-k-mers: short hash of the minimiser, document, start and number of windows, whether the minimiser stands in
    several places, and the packed strings.
    """

    key: np.ndarray
    id: np.ndarray
    mark: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    inner: np.ndarray
    text: list[bytes]


_TYPES = (np.uint32, np.int64, np.int64, np.uint32, np.uint16, np.uint8)
_COLUMNS = len(_TYPES)


def encode(part: Packed) -> bytes:
    lengths = np.array([len(t) for t in part.text], np.uint32)
    columns = [np.ascontiguousarray(c, dtype=t).tobytes() for c, t in zip(part[:_COLUMNS], _TYPES)]
    body = b"".join([len(lengths).to_bytes(4, "little"), *columns, lengths.tobytes(), *part.text])
    return zstandard.ZstdCompressor(level=3).compress(body)


class Sent(NamedTuple):
    """Super-k-mers as they travelled: columns of Packed but the strings, which are cut out of ``body`` when wanted."""

    columns: list[np.ndarray]
    body: bytes
    stops: np.ndarray
    lengths: np.ndarray


def decode(payload: bytes) -> Sent:
    body = zstandard.ZstdDecompressor().decompress(payload)
    n, at, columns = int.from_bytes(body[:4], "little"), 4, []
    for t in (*_TYPES, np.uint32):
        columns.append(np.frombuffer(body, t, n, at))
        at += n * np.dtype(t).itemsize
    return Sent(columns[:-1], body, at + np.cumsum(columns[-1].astype(np.int64)), columns[-1].astype(np.int64))


def not_alone(parts: list[Sent]) -> Packed:
    """Of all that came to a bucket, the super-k-mers whose minimiser another one has too, or that have it twice."""
    columns = [np.concatenate([p.columns[i] for p in parts]) for i in range(_COLUMNS)]
    _, code, times = np.unique(columns[0], return_inverse=True, return_counts=True)
    wanted = (times[code] > 1) | (columns[5] > 0)
    text, at = [], 0
    for part in parts:
        own = np.nonzero(wanted[at : at + len(part.stops)])[0]
        at += len(part.stops)
        stops = part.stops[own]
        text += [part.body[s:e] for s, e in zip((stops - part.lengths[own]).tolist(), stops.tolist())]
    return Packed(*(c[wanted] for c in columns), text)


def chosen(part: Packed, which: np.ndarray) -> Packed:
    return Packed(*(c[which] for c in part[:_COLUMNS]), [part.text[i] for i in np.nonzero(which)[0].tolist()])


def encode_spans(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(c, dtype=np.int64).tobytes() for c in (ids, marks, starts, stops))
    return zstandard.ZstdCompressor(level=1).compress(body)


def decode_spans(payload: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.int64).reshape(4, -1)


def dealt(ids: np.ndarray, marks: np.ndarray, owner: np.ndarray, starts: np.ndarray, windows: np.ndarray, least: np.ndarray,
          inner: np.ndarray, texts: list[bytes], width: int, buckets: int) -> pa.RecordBatch:
    """One slice's super-k-mers by bucket.

    ``owner`` is the row of each super-k-mer's document and ``starts`` its position there. Strings that occur again in
    the slice do not travel: their windows start earlier in the slice already, so the spans are known to repeat.
    """
    coded = pa.array(texts, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((starts, marks[owner], ids[owner], coded))
    again = np.zeros(len(texts), bool)
    again[order[1:]] = coded[order[1:]] == coded[order[:-1]]
    # The same place read twice (a row repeated whole) is no repeat of itself.
    same = np.zeros(len(texts), bool)
    if len(order):
        head = order[np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order))))]
        same[order] = (ids[owner[order]] == ids[owner[head]]) & (marks[owner[order]] == marks[owner[head]]) & (starts[order] == starts[head])
    bucket = (least % np.uint64(buckets)).astype(np.int64)
    key = (least >> np.uint64(32)).astype(np.uint32)
    rows: list[tuple[int, int, bytes]] = []
    go = np.nonzero(~again)[0]
    go = go[np.argsort(bucket[go], kind="stable")]
    cuts = np.nonzero(np.diff(bucket[go]))[0] + 1
    for part in np.split(go, cuts) if len(go) else []:
        rows.append((int(bucket[part[0]]), 0, encode(Packed(key[part], ids[owner[part]], marks[owner[part]], starts[part], windows[part], inner[part], [texts[i] for i in part.tolist()]))))
    gone = np.nonzero(again & ~same)[0]
    if len(gone):
        at = int(key[gone].sum()) % buckets
        rows.append((at, 1, encode_spans(ids[owner[gone]], marks[owner[gone]], starts[gone], starts[gone] + windows[gone] + width - 1)))
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "kind", "payload"])


def first_of_equal(part: Packed) -> tuple[Packed, np.ndarray, np.ndarray]:
    """Distinct strings with their earliest place; the other places, and which of them are that place read again."""
    coded = pa.array(part.text, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((part.start, part.mark, part.id, coded))
    first = np.ones(len(order), bool)
    first[1:] = coded[order[1:]] != coded[order[:-1]]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    later = order[~first]
    head = head[~first]
    differ = (part.id[later] != part.id[head]) | (part.mark[later] != part.mark[head]) | (part.start[later] != part.start[head])
    keep = np.zeros(len(order), bool)
    keep[order[first]] = True
    return chosen(part, keep), later[differ], keep


def span_batch(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (ids, marks, starts, stops)], ["id", "mark", "start", "stop"])


def merged(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, width: int) -> pa.RecordBatch:
    """Spans that the windows at these places cover, windows that touch or overlap taken together."""
    order = np.lexsort((starts, marks, ids))
    ids, marks, starts = ids[order], marks[order], starts[order].astype(np.int64)
    cut = np.ones(len(starts), bool)
    cut[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] > starts[:-1] + width)
    heads = np.nonzero(cut)[0]
    tails = np.append(heads[1:], len(starts)) - 1
    return span_batch(ids[heads], marks[heads], starts[heads], starts[tails] + width if len(tails) else starts[tails])


def covered(length: int, starts: list[int], stops: list[int]) -> np.ndarray:
    """Which of ``length`` positions lie in a span."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, np.minimum(starts, length), 1)
    np.add.at(change, np.minimum(stops, length), -1)
    return np.cumsum(change[:-1]) > 0
