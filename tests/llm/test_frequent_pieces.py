"""A phrase that stands in a third of all documents, each time in other surroundings."""

import brute
import numpy as np
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from tripleloom.llm import suffix_dedup, window_dedup
from tripleloom.llm.batches import ship
from tripleloom.llm.superkmers import LATE, decode, runs_of, tallied
from tripleloom.llm.suffix_dedup import remove_repeated_bytes
from tripleloom.llm.window_dedup import remove_repeats

PHRASE = "as everyone in this small town has long known and often said"
WORDS = window_dedup.Method(window_dedup._pieces, window_dedup._packed, window_dedup.word_windows)
BYTES = window_dedup.Method(suffix_dedup._pieces, suffix_dedup._packed, suffix_dedup.byte_windows)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    passage = " ".join(some(45))
    out = []
    for i in range(900):
        words = some(30)
        if i % 3 == 0:
            words[12:12] = PHRASE.split()
        if i % 7 == 0:
            words += [passage]
        if i % 50 == 0:
            words += ["so", "it", "goes"] * 30
        out.append((i, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(6).withColumn("mark", F.lit(0).cast("long"))


@pytest.mark.parametrize(("at_least", "share"), [(64, 0.5), (4, 0.01), (1, 0.0)])
def test_results_do_not_depend_on_what_is_late(table, texts, monkeypatch, at_least, share):
    monkeypatch.setattr(window_dedup, "AT_LEAST", at_least)
    monkeypatch.setattr(window_dedup, "SHARE", share)
    docs = table.drop("mark")
    assert by_id(remove_repeats(docs), "n_words", "n_removed", "kept_sha256") == brute.window_dedup(texts)
    assert by_id(remove_repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_dedup(texts)


def test_results_do_not_depend_on_the_number_of_buckets(table, texts, monkeypatch):
    monkeypatch.setattr(window_dedup, "BUCKET_STRINGS", 50)
    docs = table.drop("mark")
    assert by_id(remove_repeats(docs), "n_words", "n_removed", "kept_sha256") == brute.window_dedup(texts)
    assert by_id(remove_repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_dedup(texts)


@pytest.mark.parametrize(("method", "width"), [(WORDS, 20), (BYTES, 100)])
def test_no_minimiser_fills_a_bucket(spark, table, monkeypatch, method, width):
    monkeypatch.setattr(window_dedup, "AT_LEAST", 8)
    ship(spark)
    parts = 100
    late, strings = window_dedup._late_pieces(table, method, width, parts)
    assert len(late) and strings > 900

    def largest(given):
        rows = table.mapInArrow(lambda batches: method.packed(batches, width, parts, given), "bucket int, kind int, payload binary").where("kind = 0").collect()
        keys = np.concatenate([decode(bytes(r.payload)).columns[0].astype(np.int64) * parts + r.bucket for r in rows])
        return np.unique(keys, return_counts=True)[1].max(), len(keys) / parts

    hot, _ = largest(np.zeros(0, np.uint64))
    most, mean = largest(late)
    assert hot > 2 * mean >= 2 * most


def test_tally_of_no_text():
    assert list(tallied([], 0.1, 4)) == []


def test_windows_of_late_pieces_go_by_longer_ones():
    short = np.arange(1, 41, dtype=np.uint64)
    longer = np.arange(100, 132, dtype=np.uint64)
    from tripleloom.llm.superkmers import Pieces

    pieces = Pieces(short, 17, lambda: longer, 9, np.arange(24))
    plain = runs_of(pieces, np.zeros(0, np.uint64))
    assert plain.least.tolist() == list(range(1, 25))
    some = runs_of(pieces, np.array([1, 2, 3], np.uint64))
    assert some.least.tolist()[:2] == [4, 5] and some.windows.tolist()[0] == 4
    every = runs_of(pieces, short)
    assert (every.least >= LATE).all() and every.least[0] == np.uint64(100) | LATE
