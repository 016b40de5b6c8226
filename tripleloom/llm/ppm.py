"""Language-model scoring: prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of what followed them, over all training
texts. A byte is predicted in its longest known context; if it never followed there, the model escapes (method D: every
distinct byte of a context gives half a count to the escape) to the context one byte shorter, where the bytes already ruled out are excluded,
and so on down to all bytes alike. A text's score is the sum of the log10 probabilities of its bytes and of its end.

Counting is distributed: each task counts the longest strings of its slices, counts combine across the cluster, and the
shorter contexts are sums of these. ``scores`` uses every count. Strings are dealt to parts by the last bytes of their
contexts, so that a string, its contexts and their other bytes lie in one part; a context with too many strings is dealt
by one byte more, and what its shorter strings say (at most 256 counts for each such context) goes to all parts. Each
part is a trie of bounded size. Strings of the texts meet it there, but for the most frequent ones, whose
probabilities every worker has. ``train`` and ``score`` do the same with one trie in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import NO_ID, extended, mixed, nested, plain, ship, shuffle_parts, slices, stored, words_of

ORDER = 5
#: Strings whose probabilities go to every worker, 16 bytes each; all others meet their counts in the parts.
COMMON = 1_000_000
#: Longest strings of one context (of two bytes or more) that stay together, and of one part on average.
SPLIT, PART = 100_000, 300_000
#: Contexts shorter than this are whole in every part: 65,792 strings at most.
TRUNK = 2
#: Rows of a part: strings of training, strings of texts, sums of common strings.
TRAINED, ASKED, SUMMED = 0, 1, 2
#: Bytes that UTF-8 never has: before and after each text.
START, END = 0xFE, 0xFF
SYMBOLS = 256
#: What each distinct byte of a context gives to its escape.
DISCOUNT = 0.5


def strings_of(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of each text, and its end, with the ``order`` bytes before it in one number; and where texts begin."""
    texts = pc.ascii_lower(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    line = np.full(len(own) + (order + 1) * len(sizes), START, np.uint8)
    shift = np.repeat(np.arange(len(sizes)) * (order + 1) + order, sizes)
    line[np.arange(len(own)) + shift] = own
    ends = offsets[1:] + (np.arange(len(sizes)) + 1) * (order + 1) - 1
    line[ends] = END
    packed = np.zeros(max(0, len(line) - order), np.int64)
    for k in range(order + 1):
        packed |= line[k : k + len(packed)].astype(np.int64) << (8 * (order - k))
    # What starts in the padding of the next text is none of this one's.
    keep = np.ones(len(packed), bool)
    gaps = (ends[:-1] + 1)[:, None] - order + np.arange(order)[None, :] if len(ends) > 1 else np.zeros((0, order), np.int64)
    keep[gaps.reshape(-1)] = False
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    return packed[keep], begins


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    held_keys, held_counts = [], []

    def combined() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate(held_keys), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate(held_counts)).astype(np.int64)

    size = 0
    for batch in slices(batches):
        counts = pa.array(strings_of(plain(batch.column("text")), order)[0]).value_counts()
        held_keys.append(counts.field("values").to_numpy())
        held_counts.append(counts.field("counts").to_numpy())
        size += len(held_keys[-1])
        if size > 2_000_000:
            keys, n = combined()
            if len(keys) > 1_000_000:  # bounded memory: hand over and go on
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["string", "n"])
                held_keys, held_counts, size = [], [], 0
            else:
                held_keys, held_counts, size = [keys], [n], len(keys)
    if held_keys:
        keys, n = combined()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["string", "n"])


class Trie(NamedTuple):
    """Per length of string (context and one byte): sorted strings and log10 of what each says.

    ``direct[k]`` is the log probability of the last byte in the context of k bytes without exclusion, ``after[k]`` its
    log count, to be divided by ``rest`` of the longer context that was escaped from. Per context: ``escape`` without
    exclusion, and for use after an escape from it, the logs of what its shorter context has left and of the bytes new there.
    """

    strings: list[np.ndarray]
    direct: list[np.ndarray]
    after: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]
    rest: list[np.ndarray]
    onward: list[np.ndarray]
    kinds: np.ndarray


def build(strings: list[np.ndarray], counts: list[np.ndarray]) -> Trie:
    """The trie of these strings by context length 0, 1, ...; each list sorted, shorter ones hold all suffixes."""
    log = lambda x: np.log10(np.maximum(x, 1e-30))
    direct, after, contexts, escape, rest, onward = [], [], [], [], [], []
    totals, distinct = [], []
    for k, (keys, n) in enumerate(zip(strings, counts)):
        own, first = np.unique(keys >> 8, return_index=True)
        total = np.add.reduceat(n, first) if len(n) else np.zeros(0, np.int64)
        kinds = np.diff(np.append(first, len(keys)))
        contexts.append(own)
        totals.append(total)
        distinct.append(kinds)
        place = np.repeat(np.arange(len(own)), kinds)
        direct.append(log(n - DISCOUNT) - log(total)[place])
        after.append(log(n - DISCOUNT))
        escape.append(log(DISCOUNT * kinds) - log(total))
        if k == 0:
            rest.append(np.zeros(len(own)))
            onward.append(np.zeros(len(own)))
            continue
        # What the shorter context says of the bytes known here: these are excluded after an escape.
        mask = (1 << (8 * k)) - 1
        shorter = np.searchsorted(strings[k - 1], keys & mask)
        known = np.add.reduceat(counts[k - 1][shorter], first) if len(keys) else np.zeros(0, np.int64)
        up = np.searchsorted(contexts[k - 1], own & ((1 << (8 * (k - 1))) - 1))
        fresh = distinct[k - 1][up] - kinds
        left = totals[k - 1][up] - known
        rest.append(log(np.maximum(left, 1)))
        # With nothing fresh there, the escape goes on for certain.
        onward.append(np.where(fresh > 0, log(DISCOUNT * np.maximum(fresh, 1)) - log(np.maximum(left, 1)), 0.0))
    seen = np.array([int(distinct[0][0]) if len(distinct[0]) else 0])
    return Trie(strings, direct, after, contexts, escape, rest, onward, seen)


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log10_of(trie: Trie, strings: np.ndarray) -> np.ndarray:
    """Log10 probability of the last byte of each string after those before it."""
    order = len(trie.strings) - 1
    out = np.zeros(len(strings))
    open_ = np.arange(len(strings))
    # The context escaped from last, or -1 at the first one known.
    divisor = np.zeros(len(strings))
    onward = np.zeros(len(strings))
    entered = np.zeros(len(strings), bool)
    for k in range(order, -1, -1):
        if not len(open_):
            break
        keys = strings[open_] & ((1 << (8 * (k + 1))) - 1)
        at, hit = _found(trie.strings[k], keys)
        done = open_[hit]
        out[done] += np.where(entered[done], trie.after[k][at[hit]] - divisor[done], trie.direct[k][at[hit]])
        open_, keys = open_[~hit], keys[~hit]
        place, known = _found(trie.contexts[k], keys >> 8)
        miss, place = open_[known], place[known]
        out[miss] += np.where(entered[miss], onward[miss], trie.escape[k][place])
        divisor[miss], onward[miss], entered[miss] = trie.rest[k][place], trie.onward[k][place], True
    if len(open_):
        out[open_] -= math.log10(max(1, SYMBOLS - int(trie.kinds[0])))
    return out


def least_count(counted: DataFrame, most: int) -> int:
    """The least n for which at most ``most`` rows of ``counted`` (n) have n or more.

    It follows from how many rows have each n, with counts above 65,536 taken by powers of two: a short table, and a
    bound that holds however large counts are.
    """
    exact = 1 << 16
    step = F.when(F.col("n") < exact, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n") + 1e-12)).cast("long"))
    sizes = counted.groupBy(step.alias("n")).agg(F.count("*").alias("rows")).collect()
    rows = 0
    for row in sorted(sizes, key=lambda r: -r.n):
        rows += row.rows
        if rows > most:
            # Beyond the whole step: a count that a rounded logarithm puts into the step above is larger still.
            return row.n + 1 if row.n < exact else 2 * row.n + 1
    return 1


def counted(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Every distinct string of ``order`` bytes and one more in ``texts`` (column text), and its count."""
    ship(texts.sparkSession)
    longest = texts.select("text").mapInArrow(lambda batches: _counted(batches, order), "string long, n long")
    return longest.groupBy("string").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, order: int = ORDER, max_nodes: int | None = None) -> Trie:
    """The trie of all rows of ``texts`` (column text) in memory; null counts as the empty text.

    With ``max_nodes``, only strings that occur a number of times or more, the least for which the trie is no larger.
    """
    longest = counted(texts, order)
    levels = [F.struct(F.lit(k).alias("k"), F.col("string").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("string")) for k in range(order + 1)]
    every = longest.select("n", F.explode(F.array(*levels)).alias("at")).groupBy("at.k", "at.string").agg(F.sum("n").alias("n"))
    every = stored(every, "contexts")
    return build(*_by_level(every if max_nodes is None else every.where(F.col("n") >= least_count(every, max_nodes)), order))


def _by_level(frame: DataFrame, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted strings of each level 0, 1, ... and their counts; ``frame`` has k, string and n."""
    rows = frame.toArrow()
    level, string, n = (rows.column(c).to_numpy() for c in ("k", "string", "n"))
    strings, counts = [], []
    for k in range(order + 1):
        own = np.nonzero(level == k)[0]
        own = own[np.argsort(string[own])]
        strings.append(string[own].astype(np.int64))
        counts.append(n[own].astype(np.int64))
    return strings, counts


def _scored(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[pa.RecordBatch]:
    order = len(trie.strings) - 1
    for batch in slices(batches):
        strings, begins = strings_of(plain(batch.column("text")), order)
        coded = pa.array(strings).dictionary_encode()
        logs = log10_of(trie, coded.dictionary.to_numpy())[coded.indices.to_numpy()]
        columns = {name: batch.column(name) for name in batch.schema.names if name != "score"}
        columns["score"] = pa.array(np.add.reduceat(logs, begins[:-1]) if len(begins) > 1 else np.zeros(0))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """``docs`` with ``score``: log10 probability of each whole text, A to Z in lower case, and its end.

    Null is the empty text, whose only symbol is its end. Under a model without counts all bytes are alike. A column
    named score is replaced, all others stay.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(trie)
    return docs.mapInArrow(lambda batches: _scored(batches, sent.value), f"{fields}, score double")


# ---- the same with a trie in parts ------------------------------------------------------------------------------------


class Deal(NamedTuple):
    """How strings are dealt: number of parts; split contexts by length, sorted; strings and counts that all parts have."""

    order: int
    parts: int
    split: list[np.ndarray]
    strings: list[np.ndarray]
    counts: list[np.ndarray]


def deal(strings: DataFrame, order: int) -> Deal:
    """For the longest strings of training (string, n): contexts that are split, and what is known of these and the shortest ones."""
    end = lambda size: F.col("string").bitwiseAND(F.lit((1 << (8 * size)) - 1))
    context = lambda size: F.shiftright("string", 8).bitwiseAND(F.lit((1 << (8 * size)) - 1))
    split = [np.zeros(0, np.int64) for _ in range(order + 1)]
    within, known = strings, []
    for k in range(min(TRUNK, order)):
        known.append(strings.groupBy(end(k + 1).alias("string")).agg(F.sum("n").alias("n")).select(F.lit(k).alias("k"), "string", "n"))
    for k in range(TRUNK, order):
        # As many as there are strings, divided by SPLIT, at most.
        large = within.groupBy(context(k).alias("context")).count().where(F.col("count") > SPLIT)
        split[k] = np.sort(np.array([r.context for r in large.collect()], np.int64))
        if not len(split[k]):
            break
        within = within.where(context(k).isin(split[k].tolist()))
        known.append(within.groupBy(end(k + 1).alias("string")).agg(F.sum("n").alias("n")).select(F.lit(k).alias("k"), "string", "n"))
    trunk = _by_level(reduce(DataFrame.unionAll, known), order) if known else ([np.zeros(0, np.int64)] * (order + 1),) * 2
    return Deal(order, max(shuffle_parts(strings.sparkSession), -(-strings.count() // PART)), split, *trunk)


def parts_of(strings: np.ndarray, how: Deal) -> np.ndarray:
    """The part of each string: by its shortest context of ``TRUNK`` bytes or more that is not split."""
    size = min(TRUNK, how.order)
    ends = (strings >> 8) & ((1 << (8 * size)) - 1)
    key = ends | (size << 48)
    open_ = np.arange(len(strings))
    for k in range(size, how.order):
        open_ = open_[_found(how.split[k], ends[open_])[1]]
        if not len(open_):
            break
        ends[open_] = (strings[open_] >> 8) & ((1 << (8 * (k + 1))) - 1)
        key[open_] = ends[open_] | ((k + 1) << 48)
    return (mixed(key.astype(np.uint64)) % np.uint64(how.parts)).astype(np.int32)


def part_trie(strings: np.ndarray, n: np.ndarray, how: Deal) -> Trie:
    """The trie of one part: what all parts have, and all strings that end the part's own ones."""
    levels, counts = list(how.strings), list(how.counts)
    for k in range(min(TRUNK, how.order), how.order + 1):
        keys, inverse = np.unique(strings & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, n)
        # Other parts have strings of split contexts too; all parts know their sums.
        own = ~_found(how.split[k], keys >> 8)[1]
        keys, sums = np.concatenate([levels[k], keys[own]]), np.concatenate([counts[k], sums[own]])
        order = np.argsort(keys)
        levels[k], counts[k] = keys[order], sums[order]
    return build(levels, counts)


#: What travels in one binary value instead of arrays, which Spark would copy number by number.
_TIMES = np.dtype([("id", "<i8"), ("times", "<i4")])
_SUMS = np.dtype([("id", "<i8"), ("sum", "<f8")])
_PART = "part int, kind int, string long, n long, packed binary"
_PART_FIELDS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("string", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])


def _packed(bounds: np.ndarray, kind: np.dtype, *columns: np.ndarray) -> pa.Array:
    """Rows ``bounds[i]`` to ``bounds[i + 1]`` of these columns as one binary value each."""
    rows = np.zeros(len(columns[0]), kind)
    for name, column in zip(kind.names, columns):
        rows[name] = column
    offsets = (bounds * kind.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _unpacked(values: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all values, and how many each value has."""
    if not len(values):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    values = values.cast(pa.binary())
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, kind), np.zeros(len(values), np.int64)
    rows = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return rows, np.diff(offsets) // kind.itemsize


def _part_rows(rows: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows of parts; what is not given is null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _PART_FIELDS], schema=_PART_FIELDS)


def _trained(batches: Iterator[pa.RecordBatch], how: Deal) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = parts_of(batch.column("string").to_numpy(), how)
        yield _part_rows(len(parts), part=parts, kind=np.full(len(parts), TRAINED), string=batch.column("string"), n=batch.column("n"))


def _asked(batches: Iterator[pa.RecordBatch], common: np.ndarray, logs: np.ndarray, how: Deal) -> Iterator[pa.RecordBatch]:
    """Per slice: what common strings add to each text, and every other string with the texts that have it and how often."""
    for batch in slices(batches):
        ids = batch.column("_key").to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        strings, begins = strings_of(plain(batch.column("text")), how.order)
        coded = pa.array(strings).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at, hit = _found(common, distinct)
        values = np.zeros(len(distinct))
        values[hit] = logs[at[hit]]
        sums = np.add.reduceat(values[codes], begins[:-1])
        yield _part_rows(1, part=np.array([int(ids[0]) % how.parts]), kind=np.array([SUMMED]), packed=_packed(np.array([0, len(ids)]), _SUMS, ids, sums))
        use = ~hit[codes]
        owner = np.repeat(np.arange(len(ids)), np.diff(begins))
        pairs, times = np.unique(codes[use].astype(np.int64) * len(ids) + owner[use], return_counts=True)
        if not len(pairs):
            continue
        string, doc = np.divmod(pairs, len(ids))
        heads = np.nonzero(np.diff(np.concatenate([[-1], string])))[0]
        rare = distinct[string[heads]]
        yield _part_rows(
            len(rare), part=parts_of(rare, how), kind=np.full(len(rare), ASKED), string=rare, packed=_packed(np.append(heads, len(string)), _TIMES, ids[doc], times)
        )


def _met(batches: Iterator[pa.RecordBatch], how: Deal) -> Iterator[pa.RecordBatch]:
    """Part after part: the trie of its strings of training, which stand first, then what other strings add to texts."""
    part, held, trie = -1, [], None
    for batch in batches:
        parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.nonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0))[0] + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if start == stop:
                continue
            if parts[start] != part:
                part, held, trie = parts[start], [], None
            rows = batch.slice(start, stop - start)
            if kinds[start] == TRAINED:
                held.append((rows.column("string").to_numpy(), rows.column("n").to_numpy()))
                continue
            if kinds[start] == SUMMED:
                sums = _unpacked(rows.column("packed"), _SUMS)[0]
                yield pa.RecordBatch.from_arrays([pa.array(sums["id"].copy()), pa.array(sums["sum"].copy())], ["id", "part"])
                continue
            if trie is None:
                none = np.zeros(0, np.int64)
                trie, held = part_trie(*(np.concatenate([none, *c]) for c in (zip(*held) if held else ([], []))), how), []
            asking, sizes = _unpacked(rows.column("packed"), _TIMES)
            logs = np.repeat(log10_of(trie, rows.column("string").to_numpy()), sizes)
            known, inverse = np.unique(asking["id"], return_inverse=True)
            sums = np.bincount(inverse, logs * asking["times"], len(known))
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(sums)], ["id", "part"])


def whole_scores(docs: DataFrame, training: DataFrame, order: int = ORDER) -> DataFrame:
    """id and score of each row of ``docs`` (_key, which must be unique, and text) under all counts of ``training``."""
    spark = docs.sparkSession
    strings = stored(counted(training, order), "strings")
    how = deal(strings, order)
    context = F.shiftright("string", 8)
    totals = strings.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    often = strings.where(F.col("n") >= least_count(strings, COMMON)).withColumn("context", context)
    often = often.join(totals, "context").select("string", "n", "total").toArrow().sort_by("string")
    # What training has seen in its longest context needs no other one.
    n, total = (often.column(c).to_numpy() for c in ("n", "total"))
    sent = spark.sparkContext.broadcast((often.column("string").to_numpy(), np.log10(n - DISCOUNT) - np.log10(total), how))
    asked = docs.select("_key", "text").mapInArrow(lambda batches: _asked(batches, *sent.value), _PART)
    trained = strings.mapInArrow(lambda batches: _trained(batches, sent.value[2]), _PART)
    met = trained.unionAll(asked).repartition(shuffle_parts(spark), "part").sortWithinPartitions("part", "kind")
    return met.mapInArrow(lambda batches: _met(batches, sent.value[2]), "id long, part double").groupBy("id").agg(F.sum("part").alias("score"))


# ---- the word model that scores are compared with -------------------------------------------------------------------


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each word in training texts, by slice."""
    for batch in slices(batches, limit=8 << 20):
        counts = words_of(pc.ascii_lower(plain(batch.column("text")))).flat.value_counts()
        yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], ["word", "n"])


def _rare(batches: Iterator[pa.RecordBatch], common: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Per slice: words that are not common, each with the documents that have it and how often."""
    for batch in slices(batches, limit=8 << 20):
        ids = batch.column("_key").to_numpy(zero_copy_only=False)
        words = words_of(pc.ascii_lower(plain(batch.column("text"))))
        codes, distinct = words.coded()
        rare = np.fromiter((w not in common for w in distinct.to_pylist()), bool, len(distinct))
        owner = np.repeat(np.arange(len(ids)), words.counts)
        use = rare[codes]
        pairs, times = np.unique(codes[use].astype(np.int64) * max(1, len(ids)) + owner[use], return_counts=True)
        word, doc = np.divmod(pairs, max(1, len(ids)))
        heads = np.nonzero(np.diff(np.concatenate([[-1], word])))[0]
        yield pa.RecordBatch.from_arrays(
            [distinct.cast(pa.string()).take(pa.array(word[heads])), _packed(np.append(heads, len(word)), _TIMES, ids[doc], times)], ["word", "packed"]
        )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of rare words with their counts: what each document gains over words never seen."""
    for batch in batches:
        asking, sizes = _unpacked(batch.column("packed"), _TIMES)
        gain = np.repeat(np.log10(batch.column("n").to_numpy() + 1.0), sizes)
        known, inverse = np.unique(asking["id"], return_inverse=True)
        n = asking["times"].astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(known), pa.array(np.bincount(inverse, gain * n, len(known))), pa.array(np.bincount(inverse, n, len(known)).astype(np.int64))], ["id", "gain", "known"]
        )


def _based(batches: Iterator[pa.RecordBatch], common: dict[str, int], ends: int, total: int, kinds: int) -> Iterator[pa.RecordBatch]:
    """Per document: tokens, known ones among common words and the end, and the base score with all others unseen."""
    floor = math.log10(total + kinds + 1)
    for batch in slices(batches, limit=8 << 20):
        words = words_of(pc.ascii_lower(plain(batch.column("text"))))
        codes, distinct = words.coded()
        counts = np.fromiter((common.get(w, 0) for w in distinct.to_pylist()), np.float64, len(distinct))
        run = np.concatenate([[0.0], np.cumsum(np.log10(counts + 1)[codes])])
        hits = np.concatenate([[0], np.cumsum((counts > 0)[codes])])
        tokens = words.counts + 1
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns |= {
            "n_tokens": pa.array(tokens, pa.int64()),
            "_sure": pa.array(hits[words.starts[1:]] - hits[words.starts[:-1]] + (1 if ends else 0), pa.int64()),
            "_part": pa.array(run[words.starts[1:]] - run[words.starts[:-1]] + math.log10(ends + 1) - tokens * floor),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def word_scores(docs: DataFrame, training: DataFrame, most: int = 100_000, texts: DataFrame | None = None) -> DataFrame:
    """``docs`` (_key, text, ...) with n_tokens, n_known, train_tokens and base_score under smoothed word counts of ``training``.

    Tokens are words in lower case (A to Z) and one end for each text; a token's log10 probability is that of
    (c + 1) / (N + V + 1). The most frequent words, ``most`` at most, go to every executor, a bound that holds at any size;
    all other words meet their counts in a join, each word of a slice once with the documents that have it. Rows that
    share an id are taken together for what rare words add, so ids must be unique for exact scores. ``texts`` may give
    _key and text of the same rows from where they are cheaper to read.
    """
    spark = docs.sparkSession
    ship(spark)
    counts = stored(training.select("text").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    total, kinds = words + ends, kinds + (1 if ends else 0)
    common = {r.word: r.n for r in counts.where(F.col("n") >= least_count(counts, most)).collect()}
    sent = spark.sparkContext.broadcast(common)
    rare = (docs if texts is None else texts).select("_key", "text").mapInArrow(lambda batches: _rare(batches, sent.value), "word string, packed binary")
    met = rare.join(counts, "word").select("packed", "n")
    gains = met.mapInArrow(_summed, "id long, gain double, known long")
    gains = gains.groupBy("id").agg(F.sum("gain").alias("_gain"), F.sum("known").alias("_known")).withColumnRenamed("id", "_id")
    schema = extended(docs, "n_tokens long, _sure long, _part double")
    based = docs.mapInArrow(lambda batches: _based(batches, sent.value, ends, total, kinds), schema)
    joined = based.drop("text").join(gains, F.col("_key") == F.col("_id"), "left")
    return joined.select(
        *[c for c in docs.columns if c != "text"],
        "n_tokens",
        (F.col("_sure") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_part") + F.coalesce("_gain", F.lit(0.0))).alias("base_score"),
    )


def scores(docs: DataFrame, training: DataFrame, order: int = ORDER) -> DataFrame:
    """Both scores of each row of ``docs`` (doc_id, text, ...), learning from all rows of ``training`` (text).

    The text is not returned. Where ids are not unique, rows are told apart by a hash of id and text. Columns with the
    names of results are replaced, all others stay.
    """
    given = docs.drop(*(results := ["n_tokens", "n_known", "train_tokens", "base_score", "score"])).columns
    docs, back = nested(docs, results)
    back = [column for column, name in zip(back, given) if name != "text"]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows, ids = docs.agg(F.count("*"), F.count_distinct(key)).first()
    keyed = docs.withColumn("_key", key if rows == ids else F.xxhash64(key, F.coalesce("text", F.lit(""))))
    texts = keyed.select("_key", "text")
    texts = texts if rows == ids else texts.dropDuplicates(["_key"])
    found = whole_scores(texts, training, order).withColumnRenamed("id", "_id")
    based = word_scores(keyed, training, texts=texts)
    return based.join(found, F.col("_key") == F.col("_id")).select(*back, *results)
