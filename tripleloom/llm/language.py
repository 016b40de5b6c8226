"""Language identification, word first.

A word that training has seen counts with its log frequency in each language. An unseen word backs off to the longest
of its character n-grams that training has seen, position by position; n-grams that no length knows say nothing.

The model learns from a bounded sample of labelled documents and keeps every word and every n-gram of it, as sorted 64-bit
hashes with a row of frequencies each. That is a few dozen bytes a word, so the whole model goes to every executor, and
texts are judged in one pass over the table, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import hashes, plain, rolled, ship, slices, stored, words_of

UNKNOWN = "und"
LENGTHS = (4, 3, 2, 1)
#: Documents that training reads at most, dealt evenly to the languages; frequencies that the model holds at most.
SAMPLE, FREQUENCIES = 50_000, 8_000_000
#: Everything in ASCII that is no letter separates words; letters become lower case, other bytes stay.
_LETTERS = bytes(
    byte if byte >= 128 or 97 <= byte <= 122 else byte + 32 if 65 <= byte <= 90 else 32 for byte in range(256)
)


class Frequencies(NamedTuple):
    """Sorted hashes, and a row of log frequencies per hash."""

    keys: np.ndarray
    rows: np.ndarray

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of ``keys`` stands, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


class LanguageModel(NamedTuple):
    """Languages in order, log priors, words, and n-grams by length, longest first; n-gram rows are divided by the length."""

    langs: list[str]
    prior: np.ndarray
    words: Frequencies
    grams: dict[int, Frequencies]


def lettered(texts: pa.Array) -> pa.Array:
    """Texts with everything but letters and non-ASCII characters blanked, in lower case (ASCII)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if texts.buffers()[2] is None or offsets[0] == offsets[-1]:
        return texts
    # Only the bytes of these texts: a slice shares its batch's buffer.
    held = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().translate(_LETTERS)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(held)])


def gram_keys(words: list[str], lengths: tuple[int, ...]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The word of every place in the words, blanks at their ends included, and per length the hashes of the n-grams that
    begin at each place, with whether they end inside the word."""
    padded = [f" {word} " for word in words]
    owner = np.repeat(np.arange(len(words)), [len(p) for p in padded])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    made = {}
    for length in lengths:
        keys, whole = np.zeros(len(points), np.uint64), np.zeros(len(points), bool)
        runs = rolled(points, length)
        keys[: len(runs)] = runs
        whole[: len(runs)] = owner[: len(runs)] == owner[length - 1 :]
        made[length] = keys, whole
    return owner, made


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language, counted in slices."""
    for batch in slices(batches):
        langs = batch.column("lang").dictionary_encode()
        words = words_of(lettered(plain(batch.column("text"))))
        codes, distinct = words.coded()
        owner = np.repeat(langs.indices.to_numpy(zero_copy_only=False), words.counts)
        pairs, counts = np.unique(owner.astype(np.int64) * max(1, len(distinct)) + codes, return_counts=True)
        which, word = np.divmod(pairs, max(1, len(distinct)))
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.cast(pa.string()).take(pa.array(which)), distinct.cast(pa.string()).take(pa.array(word)), pa.array(counts, pa.int64())],
            ["lang", "word", "n"],
        )


def _key_counts(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Words (length 0) and n-grams of each language by hash; n-grams count once for each word of the language."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = [(0, lang, hashes(batch.column("word")), batch.column("n").to_numpy(zero_copy_only=False))]
        owner, grams = gram_keys(batch.column("word").to_pylist(), lengths)
        for length, (keys, whole) in grams.items():
            held = np.zeros(int(whole.sum()), [("lang", np.int64), ("key", np.uint64)])
            held["lang"], held["key"] = lang[owner[whole]], keys[whole]
            distinct, times = np.unique(held, return_counts=True)
            found.append((length, distinct["lang"], distinct["key"], times))
        for length, of_lang, keys, times in found:
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.cast(pa.string()).take(pa.array(of_lang)), pa.array(np.full(len(keys), length), pa.int32()), pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))],
                ["lang", "length", "key", "n"],
            )


def train(docs: DataFrame, sample: int = SAMPLE, frequencies: int = FREQUENCIES, lengths: tuple[int, ...] = LENGTHS) -> LanguageModel:
    """Fit on at most about ``sample`` documents with a language, as many of each language where there are enough.

    Documents are chosen by a hash of text and ``doc_id`` (if there is one), so copies under different ids do not move
    together, and a language with few documents keeps all of them. Every word and n-gram of the chosen documents is in the
    model. If that makes more than ``frequencies`` numbers (words and n-grams times languages), the sample is halved until
    it does not: this bounds what is sent to executors. Rows without text or language teach nothing.
    """
    ship(docs.sparkSession)
    lengths = tuple(sorted(lengths, reverse=True))
    chosen = F.xxhash64("text", *(["doc_id"] if "doc_id" in docs.columns else []))
    known = docs.select("text", "lang", F.pmod(chosen, F.lit(1 << 30)).alias("draw")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r.lang: r.rows for r in known.groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    langs = sorted(rows)
    if not langs:
        return LanguageModel([], np.zeros(0), Frequencies(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)), {})
    each = sample / len(langs)
    while True:
        share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1 << 30, int(each / rows[lang] * (1 << 30)) + 1))])
        taken = known.where(F.col("draw") < F.element_at(share, F.col("lang"))).select("text", "lang")
        words = stored(taken.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
        keyed = words.mapInArrow(lambda batches: _key_counts(batches, lengths), "lang string, length int, key long, n long")
        counts = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
        wide = stored(keyed.groupBy("length", "key").agg(*counts), "language-counts")
        if wide.count() * len(langs) <= frequencies:
            break
        each /= 2
    table = wide.orderBy("length").toArrow()
    length = table.column("length").to_numpy()
    keys = table.column("key").to_numpy().view(np.uint64)
    held = np.stack([table.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.float64)

    def of_length(n: int) -> Frequencies:
        own = length == n
        order = np.argsort(keys[own])
        logs = np.log(held[own] + 0.5) - np.log((held[own] + 0.5).sum(axis=0))
        return Frequencies(keys[own][order], (logs / max(1, n))[order].astype(np.float32))

    totals = held[length == 0].sum(axis=0)
    prior = np.log((totals + 1) / (totals.sum() + len(langs)))
    return LanguageModel(langs, prior, of_length(0), {n: of_length(n) for n in lengths})


def word_scores(words: pa.Array, model: LanguageModel) -> np.ndarray:
    """Log frequencies of words in each language; of unseen ones, from their n-grams, each for its own character."""
    size = len(model.langs)
    if not len(words) or not size:
        return np.zeros((len(words), size), np.float32)
    at, seen = model.words.found(hashes(words))
    out = np.zeros((len(words), size), np.float32)
    out[seen] = model.words.rows[at[seen]]
    unseen = np.nonzero(~seen)[0]
    if len(unseen):
        owner, grams = gram_keys(words.take(pa.array(unseen)).to_pylist(), tuple(model.grams))
        rows = np.zeros((len(owner), size))
        open_ = np.ones(len(owner), bool)
        for n, (keys, whole) in grams.items():
            places = np.nonzero(open_ & whole)[0]
            at, known = model.grams[n].found(keys[places])
            rows[places[known]] = model.grams[n].rows[at[known]]
            open_[places[known]] = False
        run = np.concatenate([np.zeros((1, size)), np.cumsum(rows, axis=0)])
        ends = np.searchsorted(owner, np.arange(len(unseen)), side="right")
        out[unseen] = run[ends] - run[np.concatenate([[0], ends[:-1]])]
    return out


def _predicted(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    size = len(model.langs)
    for batch in slices(batches):
        texts = plain(batch.column("text"))
        words = words_of(lettered(texts))
        codes, distinct = words.coded()
        table = word_scores(distinct, model)
        counts = words.counts
        sums = np.zeros((len(counts), size))
        for k in range(size):
            run = np.concatenate([[0.0], np.cumsum(table[codes, k], dtype=np.float64)])
            sums[:, k] = run[words.starts[1:]] - run[words.starts[:-1]]
        spelled = pc.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False).copy()
        for i in np.nonzero(~spelled & (counts > 0))[0].tolist():
            spelled[i] = any(c.isalpha() for c in texts[i].as_py())
        if size:
            sums = sums + model.prior
            sums -= sums.max(axis=1, keepdims=True)
            odds = np.exp(sums)
            odds /= odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1)
            score = odds[np.arange(len(best)), best]
        else:
            best, score, spelled = np.zeros(len(counts), int), np.zeros(len(counts)), np.zeros(len(counts), bool)
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        keep = {name: batch.column(name) for name in batch.schema.names}
        keep["lang_pred"] = pa.array(names[np.where(spelled, best, size)], pa.string())
        keep["score"] = pa.array(np.where(spelled, np.clip(score, 0.0, 1.0), 0.0))
        yield pa.RecordBatch.from_arrays(list(keep.values()), list(keep))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the column ``text`` is looked at.

    A text that is null or has no letter is ``und`` with score 0, as is every text under a model without languages.
    Ties go to the language that sorts first. Columns named like the results are replaced; all others stay.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: _predicted(batches, sent.value), schema)


def held_out(doc_id: Column, folds: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == rest


__all__ = ["UNKNOWN", "Frequencies", "LanguageModel", "held_out", "identify", "train", "word_scores"]
