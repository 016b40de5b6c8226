"""Operators on documents against brute force, on the smallest table and on odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import CLASHING, SF_DIR, by_id
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleloom.llm import ppm, tokens
from tripleloom.llm.decontaminate import blocks_of, decontaminate
from tripleloom.llm.fingerprints import edited_fingerprints, fingerprints_and_classes, signatures, similar_documents
from tripleloom.llm.batches import hashes
from tripleloom.llm.language import Frequencies, LanguageModel, gram_keys, identify, train, word_scores
from tripleloom.llm.near_dup import near_duplicates
from tripleloom.llm.packing import pack, plan
from tripleloom.llm.queries import QUERIES
from tripleloom.llm.suffix_dedup import remove_repeated_bytes, suffix_array
from tripleloom.llm.token_files import code_lengths, codes_of, decode_bits, decode_table, encode_bits, read_tokens, write_tokens
from tripleloom.llm.tokens import Encoder
from tripleloom.llm.window_dedup import remove_repeats
from tripleloom.session import scratch_path


# ---- substring dedup ------------------------------------------------------------------------------------------------

def _callers_columns_stay(given, found, gone=()):
    """All columns of the caller that no result is named after come back in order, with what they held."""
    kept = [c for c in given.columns if c in found.columns and c not in gone]
    results = set(found.columns) - set(given.columns)
    assert {c for c in given.columns if c not in kept} <= set(gone) and found.columns[: len(kept)] == kept and results
    own = [c for c in kept if c in CLASHING]
    assert found.where(" and ".join(f"`{c}` = 'own'" for c in own)).count() == given.count()


WINDOW = ("n_words", "n_removed", "kept_sha256")


def test_windows_of_query(spark, pairs):
    assert by_id(QUERIES["op3_substring_dedup"](spark, SF_DIR), *WINDOW) == brute.window_dedup(pairs)


@pytest.mark.parametrize("width", [5, 20])
def test_windows_of_odd_texts(odd, odd_pairs, width):
    found = remove_repeats(odd, width)
    assert by_id(found, *WINDOW) == brute.window_dedup(odd_pairs, width)
    assert found.where("block = 'own' and source is null").count() == len(odd_pairs)
    _callers_columns_stay(odd, found, gone=("n_words", "n_removed"))


def test_windows_of_messy_and_empty_tables(messy, empty):
    rows = remove_repeats(messy).groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.count_distinct("n_removed", "kept_sha256").alias("kinds")).collect()
    assert all(r.kinds == 1 for r in rows) and sum(r.n for r in rows) == messy.count()
    first = remove_repeats(messy).where("doc_id is null").select("n_removed").distinct().collect()
    assert [r.n_removed for r in first] == [0]
    assert remove_repeats(empty).count() == 0


# ---- suffix-array dedup ---------------------------------------------------------------------------------------------

BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_array():
    rng = np.random.default_rng(5)
    texts = [b"", b"a", b"\0\0", b"banana", b"ab" * 30, *(bytes(rng.integers(0, k, n, dtype=np.uint8)) for k in (1, 2, 3, 256) for n in (7, 60, 200))]
    for text in texts:
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_bytes_of_query(spark, pairs):
    assert by_id(QUERIES["op8_suffix_dedup"](spark, SF_DIR), *BYTES) == brute.byte_dedup(pairs)


@pytest.mark.parametrize("width", [24, 100])
def test_bytes_of_odd_texts(odd, odd_pairs, width):
    pairs = [p for p in odd_pairs if p[0] != 10]
    found = remove_repeated_bytes(odd.where("doc_id != 10"), width)
    assert by_id(found, *BYTES) == brute.byte_dedup(pairs, width)
    _callers_columns_stay(odd.where("doc_id != 10"), found, gone=("kept", "n_removed"))


def test_bytes_of_messy_and_empty_tables(messy, empty):
    assert remove_repeated_bytes(messy).count() == messy.count()
    assert remove_repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_bytes(empty, 10)


# ---- near-duplicates ------------------------------------------------------------------------------------------------

NEAR = ("n_shingles", "component_id", "kept")


def test_near_duplicates_of_query(spark, pairs):
    assert by_id(QUERIES["op4_near_dedup"](spark, SF_DIR), *NEAR) == brute.near_duplicates(pairs, 4)


@pytest.mark.parametrize("words", [1, 4, 5])
def test_near_duplicates_of_odd_texts(odd, odd_pairs, words):
    assert by_id(near_duplicates(odd, words), *NEAR) == brute.near_duplicates(odd_pairs, words)


def test_near_duplicates_in_large_stars(spark, monkeypatch):
    """More candidates than a block holds, chained so that the centre does not reach all."""
    from tripleloom.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = np.random.default_rng(2)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            text[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(text)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert by_id(found, *NEAR) == brute.near_duplicates(rows, 2)


def test_near_duplicates_of_messy_and_empty_tables(messy, empty):
    rows = near_duplicates(messy, 4).collect()
    assert len(rows) == messy.count()
    # Null ids share a text with 4, 5 and with 6, and come first.
    assert all(r.component_id is None for r in rows if r.doc_id in (None, 4, 5, 6, 7, 8, 13))
    assert near_duplicates(empty).count() == 0


# ---- decontamination ------------------------------------------------------------------------------------------------

HITS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_hits_of_query(spark, pairs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert by_id(QUERIES["op2_decontamination"](spark, SF_DIR), *HITS) == brute.decontaminate(pairs, items)


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_hits_of_odd_texts(spark, odd, odd_pairs, monkeypatch, limit):
    """With one automaton and with many blocks."""
    from tripleloom.llm import decontaminate as module

    items = [(7, odd_pairs[5][1][20:140]), (7, "AGAIN, and!"), (70, "été naïve"), (8, None), (9, " ;"), (10, "34"), (11, "nothing of this")]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(module, "blocks_of", lambda b, w: blocks_of(b, w, limit))
    found = decontaminate(odd, table)
    wanted = brute.decontaminate(odd_pairs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]).encode()), r.n_hit > 0) for r in found.collect()}
    assert got == wanted
    row = found.where("doc_id = 11").first()
    assert [row.text[s.start : s.stop] for s in row.spans][0] == "été naïve"


def test_hits_of_messy_and_empty_tables(spark, messy, empty):
    items = spark.createDataFrame([(None, "one"), (1, "again and")], "item_id long, text string")
    found = decontaminate(messy, items)
    assert found.count() == messy.count()
    assert [r["items"] for r in found.where("doc_id = 4").collect()] == [[]] and found.where("doc_id = 4").first().n_hit == 1
    assert decontaminate(empty, items).count() == 0
    assert decontaminate(messy, items.where("false")).where("n_hit > 0").count() == 0


# ---- tokens, packing, files -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def coder(request):
    return Encoder(public_tokenizers.path(request.param))


def test_pieces_give_the_ids_of_whole_texts(coder, pairs, odd_pairs):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "a", "B", "'s", "é", "1", "½", "!", "\t", "Σ", "\u0301", "日", "\x1c", "\x85", "T", "re", "ſ", "😀"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(2000)] + [t or "" for _, t in [*pairs, *odd_pairs]]
    ids = coder.encode(pa.array(texts), 1)
    whole = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(ids.flat[a:b].tolist() == [*w.ids, 1] for a, b, w in zip(ids.starts[:-1], ids.starts[1:], whole))


def test_pre_tokens_are_encoded_once_and_together(monkeypatch):
    """New pieces go to the tokenizer as distinct pre-tokens, all in one call, lines included; known ones not again."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder, calls = Encoder(public_tokenizers.path(name)), []
        spelled = coder._spelled
        monkeypatch.setattr(coder, "_spelled", lambda parts, spelled=spelled, calls=calls: calls.append(parts.to_pylist()) or spelled(parts))
        monkeypatch.setattr(coder, "_part", lambda part: pytest.fail(part))
        monkeypatch.setattr(coder, "whole", lambda text: pytest.fail(text))
        # A piece that opens a text has no space before it where spaces belong to pre-tokens; it goes alone.
        monkeypatch.setattr(coder, "piece", lambda piece, space="": tuple(coder.tokenizer.encode(space + piece, add_special_tokens=False).ids))
        texts = ["ab river, river. river", "ab river.\nStone river, stone", "ab stone's river; river.\nStone"]
        ids = [coder.encode(pa.array([text])).flat.tolist() for text in texts]
        assert ids == [w.ids for w in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        seen = [part for call in calls for part in call]
        assert len(seen) == len(set(seen)) and len(calls) == len(texts)


def test_full_caches_lose_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = Encoder(public_tokenizers.path(name))
        texts = [" ".join(f"w{i * j % 13}x, é{j}\nÿ" for j in range(9)) for i in range(6)]
        for _ in range(2):
            found = [coder.encode(pa.array([text])).flat.tolist() for text in texts]
            assert found == [w.ids for w in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(coder.pieces_held.keys) == len(coder.parts_held.keys) == 5


def _check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_query(spark, pairs):
    rows = QUERIES["op5_packing"](spark, SF_DIR).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {}
    for (doc_id, _), encoded in zip(pairs, tokenizer.encode_batch([t or "" for _, t in pairs], add_special_tokens=False)):
        ids = [*encoded.ids, 0]
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        wanted |= {(doc_id, n): (a, b - a, brute.crc(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == wanted
    used = _check_packing(rows, 2048)
    assert used <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1


def test_packing_of_messy_and_empty_tables(messy, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack(messy, path, capacity=64, with_ids=True).collect()
    _check_packing(rows, 64)
    assert all(len(r.ids) == r.length and brute.crc(i & 0xFFFFFFFF for i in r.ids) == r.ids_crc32 for r in rows)
    assert sum(r.piece == 0 for r in rows) == messy.count()
    assert pack(empty, path).count() == 0


def test_plan_is_as_good_as_pairs_allow():
    made = plan({60: 3, 50: 2, 41: 4, 40: 3, 34: 1, 10: 7, 1: 5}, 100)
    assert made.sequences == 7 and made.count.sum() == 25
    assert plan({}, 100).sequences == 0
    assert plan({100: 2, 51: 3}, 100).sequences == 5
    assert plan({1: 250}, 100).sequences == 3
    with pytest.raises(ValueError):
        plan({101: 1}, 100)


@pytest.mark.parametrize("size", [0, 1, 2, 5, 4000])
def test_codes_round_trip(size):
    rng = np.random.default_rng(size)
    counts = np.zeros(5000, np.int64)
    counts[rng.choice(5000, size, replace=False)] = (1.0 / rng.random(size) ** 3).astype(np.int64) + 1 if size else 0
    lengths = code_lengths(counts)
    assert lengths.max(initial=0) <= 16 and (lengths > 0).sum() == size
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    used = np.nonzero(lengths)[0]
    for n in (0, 1, 127, 128, 1000) if size else (0,):
        ids = rng.choice(used, n) if size else np.zeros(0, np.int64)
        bits, checkpoints = encode_bits(ids, lengths, codes_of(lengths))
        assert decode_bits(bits, checkpoints, n, decode_table(lengths)).tolist() == ids.tolist()


def test_lengths_are_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = [(int(c), 0) for c in counts]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 0))
    assert int((code_lengths(counts) * counts).sum()) == total


def test_files_of_query(spark, pairs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted, at = {}, 0
    for (doc_id, _), encoded in zip(pairs, tokenizer.encode_batch([t or "" for _, t in pairs], add_special_tokens=False)):
        ids = [*encoded.ids, 1]
        wanted[doc_id] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert by_id(QUERIES["op6_token_files"](spark, SF_DIR), "start", "n_tokens", "ids_crc32") == wanted


def test_files_of_messy_and_empty_tables(spark, messy, empty):
    for table in (messy, empty):
        path = scratch_path(spark, "files")
        write_tokens(table, path, public_tokenizers.path("word_bpe_49k.json"))
        rows = sorted(read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
        assert len(rows) == table.count()
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)
        assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in rows)


# ---- language -------------------------------------------------------------------------------------------------------


def _plain_languages(rows, training):
    """Language and score of each text by the method, over dictionaries of words and n-grams."""
    blank = lambda t: "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in t or "")
    split = lambda t: blank(t).split(" ")
    words, grams = {}, {n: {} for n in (4, 3, 2, 1)}
    for text, lang in training:
        for word in split(text):
            if word:
                words.setdefault(word, Counter())[lang] += 1
    langs = sorted({lang for _, lang in training})
    for word, counts in words.items():
        for n in grams:
            for lang in counts:
                grams[n].update({f" {word} "[i : i + n]: grams[n].get(f" {word} "[i : i + n], Counter()) + Counter([lang]) for i in range(len(word) + 3 - n)})
    totals = {lang: sum(c[lang] for c in words.values()) for lang in langs}
    prior = [math.log((totals[lang] + 1) / (sum(totals.values()) + len(langs))) for lang in langs]
    sums = {n: {lang: sum(x[lang] + 0.5 for x in t.values()) for lang in langs} for n, t in ((0, words), *grams.items())}
    row = lambda n, key: [math.log((({0: words} | grams)[n][key][lang] + 0.5) / sums[n][lang]) / max(1, n) for lang in langs]
    out = {}
    for key, text in rows:
        if not any(c.isalpha() for c in text or ""):
            out[key] = ("und", 0.0)
            continue
        score = list(prior)
        for word in split(text):
            found = [row(0, word)] if word in words else []
            if word and not found:
                padded = f" {word} "
                for at in range(len(padded)):
                    n = next((n for n in grams if at + n <= len(padded) and padded[at : at + n] in grams[n]), None)
                    found += [row(n, padded[at : at + n])] if n else []
            score = [a + sum(f[i] for f in found) for i, a in enumerate(score)]
        odds = [math.exp(s - max(score)) for s in score]
        best = odds.index(max(odds))
        out[key] = (langs[best], odds[best] / sum(odds))
    return out


def test_languages_of_query(spark, docs):
    """The whole query against plain dictionaries, and its accuracy on documents it has not seen."""
    rows = docs.select("doc_id", "text", "lang").collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    wanted = _plain_languages([(r.doc_id, r.text) for r in rows], [(r.text, r.lang) for r in rows if not out(r.doc_id) and r.text and r.lang])
    found = QUERIES["op9_language"](spark, SF_DIR).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.held_out, r.lang_pred) == (out(r.doc_id), wanted[r.doc_id][0])
        assert r.score == pytest.approx(wanted[r.doc_id][1], rel=1e-3)
    given = {r.doc_id: r.lang for r in rows}
    judged = [r for r in found if r.held_out and given[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == given[r.doc_id] for r in judged) >= 0.95 * len(judged)


def test_word_scores():
    keys = lambda *grams: np.array([gram_keys([g], (len(g),))[1][len(g)][0][1] for g in grams], np.uint64)
    of = lambda k, rows: Frequencies(np.sort(k), np.array(rows, np.float32)[np.argsort(k)])
    model = LanguageModel(["a", "b"], np.zeros(2), of(hashes(pa.array(["known"])), [[-1, -9]]), {2: of(keys("xy"), [[-0.5, -3.5]]), 1: of(keys("x", "é"), [[-5, -1], [-2, -4]])})
    # " xyx ": the pair, then nothing for y, then the single x.
    found = word_scores(pa.array(["known", "xyx", "q", "éq"]), model).tolist()
    assert found == [[-1.0, -9.0], [-5.5, -4.5], [0.0, 0.0], [-2.0, -4.0]]


def test_languages_learn_from_a_bounded_sample(spark):
    """Few documents of a language are all kept, copies do not move together, and a large model halves its sample."""
    rows = [(i, "the same words again", "en") for i in range(900)] + [(1000 + i, f"seltenes wort{chr(97 + i)}", "de") for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(table, sample=100)
    assert model.langs == ["de", "en"] and len(model.words.keys) == 4 + 6
    english = np.exp(model.prior[1])
    assert 0.6 < english < 0.98
    small = train(spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(400)], table.schema), frequencies=500)
    assert 0 < len(small.words.keys) + sum(len(g.keys) for g in small.grams.values()) <= 500


def test_languages_of_messy_and_empty_tables(docs, messy, empty):
    model = train(docs)
    rows = identify(messy, model).collect()
    assert len(rows) == messy.count() and all(r.block == "own" for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 12}
    assert identify(empty, model).count() == 0
    nothing = train(empty)
    assert nothing.langs == [] and {r.lang_pred for r in identify(messy, nothing).collect()} == {"und"}


# ---- language model -------------------------------------------------------------------------------------------------


def test_a_count_bounds_rows_however_large_counts_are(spark):
    for base in (10, 100_000, 1 << 40):
        table = spark.createDataFrame([(base + i,) for i in range(50)] + [(1,)] * 30, "n long")
        assert table.where(F.col("n") >= ppm.least_count(table, 10)).count() <= 10
        assert table.where(F.col("n") >= ppm.least_count(table, 60)).count() == (50 if base > 1 else 60)
        assert table.where(F.col("n") >= ppm.least_count(table, 80)).count() == 80


def test_scores_leave_the_callers_columns(odd):
    found = ppm.scores(odd, odd)
    _callers_columns_stay(odd, found, gone=("text", "score"))
    assert found.count() == odd.count()


def test_scores_of_query(spark, pairs):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*brute.SPACED.findall((t or "").translate(brute.LOWER)), None]
    counts = Counter(token for i, t in pairs if not held(i) for token in tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op7_ppm"](spark, SF_DIR).collect()
    assert len(rows) == len(pairs)
    by = {r.doc_id: r for r in rows}
    for i, t in pairs:
        own = tokens(t)
        assert (by[i].held_out, by[i].n_tokens, by[i].n_known, by[i].train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), n)
        assert by[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert by[i].score < 0


def _plain_ppm(counts, order, text):
    """log10 probability of ``text`` and its end, one symbol at a time."""
    total, line = 0.0, [ppm.START] * order + list(text) + [ppm.END]
    for at in range(order, len(line)):
        ruled_out, p = set(), 1.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in counts.get(tuple(line[at - k : at]), {}).items()}
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in ruled_out}
            mass = sum(left.values())
            if line[at] in left:
                p *= (left[line[at]] - ppm.DISCOUNT) / mass
                break
            if left:
                p *= ppm.DISCOUNT * len(left) / mass
            ruled_out |= set(seen)
        else:
            p /= 256 - len(ruled_out)
        total += math.log10(p)
    return total


def test_scores_are_those_of_a_plain_trie(spark):
    training = ["the cat sat", "The cat ran on", "", "a dog sat on the mat", None]
    texts = [(1, "the cat sat on a dog"), (2, ""), (3, None), (4, "zzz été"), (5, "THE MAT")]
    order = 3
    counts = {}
    for text in training:
        line = [ppm.START] * order + list((text or "").lower().encode()) + [ppm.END]
        for at in range(order, len(line)):
            for k in range(order + 1):
                own = counts.setdefault(tuple(line[at - k : at]), Counter())
                own[line[at]] += 1
    trie = ppm.train(spark.createDataFrame([(t,) for t in training], "text string"), order)
    found = ppm.score(spark.createDataFrame(texts, "doc_id long, text string"), trie).collect()
    for r in found:
        assert r.score == pytest.approx(_plain_ppm(counts, order, (r.text or "").lower().encode()))


def test_a_small_trie_keeps_the_frequent_strings(spark):
    texts = spark.createDataFrame([("the cat sat on the mat " * 3,), ("unlike anything",)], "text string")
    small = ppm.train(texts, 3, max_nodes=40)
    assert 0 < sum(map(len, small.strings)) <= 40
    contexts = np.array([[int.from_bytes(b" th" + bytes([s]), "big") for s in range(256)]])
    assert (10 ** ppm.log10_of(small, contexts[0])).sum() == pytest.approx(1)


def _ppm_counts(texts, order):
    counts = {}
    for text in texts:
        line = [ppm.START] * order + list((text or "").lower().encode()) + [ppm.END]
        for at in range(order, len(line)):
            for k in range(order + 1):
                counts.setdefault(tuple(line[at - k : at]), Counter())[line[at]] += 1
    return counts


def test_scores_use_every_count(spark):
    """Training with more strings of orders 0 to 5 than a million."""
    draw = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789 .,;:!?-+*/=()[]{}<>é"))
    training = ["".join(draw.choice(letters, 4000)) for _ in range(110)]
    counts = _ppm_counts(training, ppm.ORDER)
    assert sum(map(len, counts.values())) > 1_000_000
    texts = [(1, training[0][:300]), (2, training[1][100:200] + training[2][:100]), (3, "".join(draw.choice(letters, 200))), (4, None)]
    found = ppm.scores(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(t,) for t in training], "text string"))
    by = {r.doc_id: r.score for r in found.collect()}
    for doc_id, text in texts:
        assert by[doc_id] == pytest.approx(_plain_ppm(counts, ppm.ORDER, (text or "").lower().encode()), rel=1e-6)


@pytest.mark.parametrize(("common", "split", "part"), [(5, 3, 20), (0, 1, 7), (10_000, 100, 1000)])
def test_scores_from_parts(spark, messy, monkeypatch, common, split, part):
    """Contexts split at every length; rows with one id keep their own scores."""
    for name, value in (("COMMON", common), ("SPLIT", split), ("PART", part)):
        monkeypatch.setattr(ppm, name, value)
    training = messy.where("doc_id is null or doc_id not in (7, 10)")
    counts = _ppm_counts([r.text for r in training.select("text").collect()], ppm.ORDER)
    asked = messy.withColumn("whole", messy["text"])
    rows = ppm.scores(asked, training).collect()
    assert len(rows) == messy.count()
    plain = {t: _plain_ppm(counts, ppm.ORDER, (t or "").lower().encode()) for t in {r.whole for r in rows}}
    for r in rows:
        assert r.score == pytest.approx(plain[r.whole], rel=1e-6)


def test_scores_of_messy_and_empty_tables(messy, empty):
    rows = ppm.scores(messy, messy).collect()
    assert len(rows) == messy.count() and all(r.score < 0 for r in rows)
    assert ppm.scores(empty, messy).count() == 0
    alone = ppm.scores(messy, empty).where("doc_id = 2").first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (1, 0, 0, 0.0)
    assert alone.score == pytest.approx(-math.log10(256))


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def _edited(pairs):
    texts = [t or "" for _, t in pairs]
    return [t[: len(t) - len(t) // 4] + texts[(n + 1) % len(texts)][: len(t) // 4] for n, t in enumerate(texts)]


def _hold_fingerprints(frame, pairs):
    import pyarrow as pa

    texts, edited = [t or "" for _, t in pairs], _edited(pairs)
    own, new = signatures(pa.array(texts)), signatures(pa.array(edited))
    rows = {r.doc_id: r for r in frame.collect()}
    assert len(rows) == len(pairs)
    for n, (doc_id, _) in enumerate(pairs):
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(texts[n]), hashlib.sha256(edited[n].encode()).hexdigest())
        assert r.fingerprint == own[n].astype(">u4").tobytes().hex() and r.edited_fingerprint == new[n].astype(">u4").tobytes().hex()
        assert r.near_edited == pytest.approx((own[n] == new[n]).mean())
        assert r.near_next == pytest.approx((own[n] == own[(n + 1) % len(own)]).mean())


def test_fingerprints_of_query(spark, pairs):
    frame = QUERIES["op10_fingerprints"](spark, SF_DIR)
    _hold_fingerprints(frame, pairs)
    edited = _edited(pairs)
    error = [
        abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1))
        for r in frame.orderBy("doc_id").collect()
        for a, b in [(brute.shingles(pairs[r.doc_id][1], 5), brute.shingles(edited[r.doc_id], 5))]
    ]
    assert sum(error) / len(error) < 0.08
    assert by_id(frame, "class_id") == {i: (root,) for i, (_, root, _) in brute.near_duplicates(pairs, 5).items()}


def test_fingerprints_of_odd_texts(odd, odd_pairs):
    _hold_fingerprints(edited_fingerprints(odd), odd_pairs)
    _hold_fingerprints(edited_fingerprints(odd.where("doc_id = 6")), [odd_pairs[5]])


def test_fingerprints_of_messy_and_empty_tables(messy, empty):
    assert edited_fingerprints(messy).count() == messy.count()
    assert edited_fingerprints(empty).count() == 0
    assert fingerprints_and_classes(messy).count() == messy.count()
    assert fingerprints_and_classes(empty).count() == 0


def test_many_rows_of_one_id(spark):
    """Rows that share an id, or have none, stay as many as they are."""
    rows = spark.createDataFrame([(None, f"a b c d e f {i % 3}") for i in range(40)] + [(7, "x y")] * 20, "doc_id long, text string")
    assert similar_documents(rows).count() == fingerprints_and_classes(rows).count() == 60


def test_similar_documents(odd, odd_pairs, messy, empty):
    wanted = brute.near_duplicates(odd_pairs, 5)
    assert by_id(similar_documents(odd), "class_id") == {i: (root,) for i, (_, root, _) in wanted.items()}
    assert similar_documents(messy).count() == messy.count()
    assert similar_documents(empty).count() == 0
