"""Benchmark decontamination with an Aho-Corasick automaton over the words of test items.

Texts are normalised (A to Z in lower case; words are runs of a to z, 0 to 9 and non-ASCII characters). Every distinct
word of the benchmark is one character of the automaton's alphabet, any other word a character that no pattern has, so
a text is scanned once, word by word, and a hit's place is a word number that maps back to the original text.

The automaton holds the windows of one block of items. Blocks have a fixed size, so what is sent to the executors is
bounded; for a benchmark of several blocks the texts are scanned once for each, and hits add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, plain, ship, slices, stored, words_of

#: Normalised bytes of benchmark text in one automaton: at most about 2 million nodes.
BLOCK_BYTES = 1 << 20
_NORMAL = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_RESULTS = ("n_words", "n_hit", "items", "spans")
_END, _OTHER = 1, 2


def normalised(texts: pa.Array) -> pa.Array:
    """The texts with A to Z lowered and a space for each separator; byte offsets stay as they are."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(data.to_pybytes().translate(_NORMAL))], offset=texts.offset)


def _characters(numbers: np.ndarray) -> str:
    """One character for each number, leaving out the surrogates."""
    return (numbers + 3 + np.where(numbers + 3 >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")


class Automaton:
    """Windows of the items of one block."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        words = sorted({w for _, item in items for w in item})
        self.numbers = {w: i for i, w in enumerate(words)}
        patterns: dict[str, set] = {}
        for name, item in items:
            line = _characters(np.array([self.numbers[w] for w in item], np.int64)) if item else ""
            for at in range(max(1, len(line) - window + 1) if line else 0):
                patterns.setdefault(line[at : at + window], set()).add(name)
        self.patterns = {p: sorted(n for n in names if n is not None) for p, names in patterns.items()}
        self._built()

    def _built(self) -> None:
        self.vocabulary = pa.array(list(self.numbers), pa.binary())
        self.found = ahocorasick.Automaton()
        for pattern, names in self.patterns.items():
            self.found.add_word(pattern, (len(pattern), names))
        self.found.make_automaton()

    def __getstate__(self) -> dict:
        return {"numbers": self.numbers, "patterns": self.patterns}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._built()

    def hits(self, words: Words) -> list[tuple[int, int, list[str]]]:
        """(first word, word after the last, items) of each occurrence, in positions of the slice."""
        if not self.patterns or not len(words.flat):
            return []
        codes = pc.fill_null(pc.index_in(words.flat.cast(pa.binary()), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        line = np.where(codes < 0, _OTHER, codes + 3 + np.where(codes + 3 >= 0xD800, 0x800, 0))
        # A mark after each text keeps matches inside it.
        line = np.insert(line, words.starts[1:], _END)
        owner_shift = np.repeat(np.arange(len(words.counts)), words.counts + 1)
        out = []
        for end, (length, names) in self.found.iter(line.astype("<u4").tobytes().decode("utf-32-le")):
            stop = end + 1 - int(owner_shift[end])
            out.append((stop - length, stop, names))
        return out


def _scanned(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = plain(batch.column("text"))
        clean = normalised(texts)
        words = words_of(clean)
        change = np.zeros(len(words.flat) + 1, np.int64)
        items: dict[int, set] = {}
        if "spans" in batch.schema.names:
            for i, (spans, names) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                items[i] = set(names)
                for span in spans:
                    change[words.starts[i] + span["first"]] += 1
                    change[words.starts[i] + span["last"] + 1] -= 1
        for start, stop, names in automaton.hits(words):
            change[start] += 1
            change[stop] -= 1
            items.setdefault(int(np.searchsorted(words.starts, start, side="right")) - 1, set()).update(names)
        hit = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[words.starts[1:]] - total[words.starts[:-1]]
        spans = [_spans(texts[i].as_py(), clean[i].as_py(), hit[words.starts[i] : words.starts[i + 1]]) if n_hit[i] else [] for i in range(len(n_hit))]
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns |= {
            "n_words": pa.array(words.counts, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "items": pa.array([sorted(items.get(i, ())) for i in range(len(n_hit))], pa.list_(pa.string())),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _spans(text: str, clean: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words: character offsets in the original text, and the numbers of the first and last word."""
    change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    words = [m.span() for m in re.finditer(r"[^ ]+", clean)]
    return [
        {"start": words[a][0], "stop": words[b - 1][1], "first": a, "last": b - 1}
        for a, b in zip(np.nonzero(change == 1)[0].tolist(), np.nonzero(change == -1)[0].tolist())
    ]


def blocks_of(benchmark: DataFrame, window: int, limit: int = BLOCK_BYTES) -> Iterator[Automaton]:
    """Automata over the items in blocks of at most ``limit`` bytes or one item, read one at a time."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        words = row.text.encode().translate(_NORMAL).split()
        if held and size + len(row.text) > limit:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((row.item, words))
        size += len(row.text)
    yield Automaton(held, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as text, sorted) and spans of hit words.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A word of
    a document is hit if an occurrence of any window covers it; ``items`` are those with an occurring window. Null and
    empty texts have no words. Items without text or words have no window; items that share an id count once, and
    items without id hit but are not named. ``spans`` give each run of hit words by character offsets in the text as it
    came and by word numbers. Columns with the names of results are replaced, all others stay.
    """
    docs = docs.drop(*_RESULTS)
    names = [f"`{f.name.replace('`', '``')}`" for f in docs.schema]
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    schema = f"{fields}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long,first:long,last:long>>"
    spark = docs.sparkSession
    ship(spark)
    found = docs
    for number, automaton in enumerate(blocks_of(benchmark, window)):
        if number:
            found = stored(found, "hits")  # one automaton at a time in an executor's memory
        sent = spark.sparkContext.broadcast(automaton)
        found = found.mapInArrow(lambda batches, sent=sent: _scanned(batches, sent.value), schema)
    return found
