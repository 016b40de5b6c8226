"""Token ids of public tokenizers, with every distinct piece of text encoded once.

A text is cut in front of every single space that stands between two other characters. Neither tokenizer's rules let a
token or a look-ahead cross such a place, so the ids of a text are those of its pieces in a row. Pieces repeat a great
deal; Arrow numbers the distinct ones of a slice, and a bounded cache keeps those seen before. New ones are cut into
pre-tokens, of which another cache keeps those seen before; the rest of a slice is encoded in one call of the tokenizer,
with a mark between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

#: Pieces whose characters Python and the tokenizer class alike without doubt: no rare controls, no late additions.
_SIMPLE = regex.compile(r"[\n\x20-\x7e\xa1-ɏ]*")
_LATIN = regex.compile(r"[\n\x20-\x7e\xa1-\xac\xae-\xff]*")
#: Pieces in a cache, and pre-tokens in another: some 20 MB each.
CACHE = 400_000


class Ids(NamedTuple):
    """Ids of several texts; text i has ``flat[starts[i]:starts[i + 1]]``."""

    flat: np.ndarray
    starts: np.ndarray


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Held:
    """Ids of strings seen before, the first ``CACHE`` of them."""

    def __init__(self) -> None:
        self.keys = pa.array([], pa.string())
        self.held = Ids(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def ids(self, strings: pa.Array, encode: Callable[[pa.Array], Ids]) -> Ids:
        """Ids of distinct strings; ``encode`` gives those of new ones."""
        at = pc.index_in(strings, self.keys)
        unseen = strings.filter(at.is_null())
        fresh = encode(unseen)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[new] = len(self.keys) + np.arange(len(unseen))
        starts = np.concatenate([self.held.starts, len(self.held.flat) + fresh.starts[1:]])
        flat = np.concatenate([self.held.flat, fresh.flat])
        room = min(CACHE - len(self.keys), len(unseen))
        if room > 0:
            self.keys = pa.concat_arrays([self.keys, unseen.slice(0, room)])
            self.held = Ids(flat[: starts[len(self.keys)]].copy(), starts[: len(self.keys) + 1].copy())
        sizes = np.diff(starts)[at]
        return Ids(flat[_ranges(starts[at], sizes)], np.concatenate([[0], np.cumsum(sizes)]))


def _of_simple(category: str) -> str:
    """The characters of simple pieces in a Unicode category, for a class of ``re``, which is faster than ``regex``."""
    return "".join([f"\\u{n:04x}" for n in range(0x250) if _SIMPLE.fullmatch(chr(n)) and regex.match(category, chr(n))])


class Encoder:
    """Encodes slices of texts with one of the public tokenizer files; kept per Python worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.word_ends = self.tokenizer.model.end_of_word_suffix == "</w>"
        self.split = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
            if self.word_ends
            else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.letters = _byte_letters()
        self.parts: dict[str, tuple[int, ...]] = {}
        letter, digit = _of_simple(r"\p{L}"), _of_simple(r"\p{N}")
        # The same rules for pieces in a row: a space begins each piece, or stands alone before it.
        self.split_simple = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+| "
            if self.word_ends
            else rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+"
        )
        # Pre-tokens go to the model as they are. The mark between them stands for a byte that no UTF-8 text has.
        mark = self.letters[255]
        self.spelled = Tokenizer.from_file(path)
        self.spelled.normalizer, self.spelled.pre_tokenizer, self.spelled.post_processor = None, Split(mark, "isolated"), None
        self.spelled.encode_special_tokens = True
        (self.mark,) = self.spelled.encode(mark, add_special_tokens=False).ids
        self.spelling = np.array([ord(mark), *[ord(self.letters[b]) for b in range(1, 256)]], np.dtype("<u4"))
        self.pieces_held, self.parts_held = Held(), Held()

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of one pre-token, by the tokenizer's model."""
        found = self.parts.get(part)
        if found is None:
            if part.isascii() and part.isalnum():
                spelled = part
            elif part[0] == " " and part.isascii() and part[1:].isalnum():
                spelled = self.letters[32] + part[1:]
            else:
                spelled = "".join([self.letters[b] for b in part.encode()])
            found = tuple([t.id for t in self.tokenizer.model.tokenize(spelled)])
            if len(self.parts) < CACHE:
                self.parts[part] = found
        return found

    def piece(self, piece: str, space: str = "") -> tuple[int, ...]:
        """Ids of one piece after ``space``."""
        if not (_LATIN if self.word_ends else _SIMPLE).fullmatch(piece):
            return tuple(self.tokenizer.encode(space + piece, add_special_tokens=False).ids)
        if self.word_ends:
            piece, space = piece.lower(), ""
        if piece.isalpha():
            return self._part(space + piece)
        if piece[:-1].isalpha() and piece[-1] in ",.":
            return self._part(space + piece[:-1]) + self._part(piece[-1])
        out: tuple[int, ...] = ()
        for part in self.split.findall(space + piece):
            out += self._part(part)
        return out

    def _pieces(self, pieces: pa.Array) -> Ids:
        """Ids of distinct pieces, each after a space."""
        space = "" if self.word_ends else " "
        simple = pc.match_substring_regex(pieces, rf"\A{(_LATIN if self.word_ends else _SIMPLE).pattern}\z").to_numpy(zero_copy_only=False)
        others = [self.piece(piece, space) for piece in pieces.filter(pa.array(~simple)).to_pylist()]
        row = "".join([" " + piece for piece in pieces.filter(pa.array(simple)).to_pylist()])
        parts = pa.array(self.split_simple.findall(row.lower() if self.word_ends else row), pa.string())
        opens = pc.starts_with(parts, " ").to_numpy(zero_copy_only=False)
        of_part = np.cumsum(opens) - 1
        if self.word_ends:
            parts, of_part = parts.filter(pa.array(~opens)), of_part[~opens]
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        own = self.parts_held.ids(coded.dictionary, self._spelled)
        sizes = np.diff(own.starts)[codes]
        flat = own.flat[_ranges(own.starts[codes], sizes)]
        lengths = np.zeros(len(pieces), np.int64)
        lengths[simple] = np.bincount(of_part, weights=sizes, minlength=int(simple.sum())).astype(np.int64)
        if others:
            lengths[~simple] = np.fromiter(map(len, others), np.int64, len(others))
            of_others = np.repeat(~simple, lengths)
            both = np.zeros(int(lengths.sum()), np.uint32)
            both[~of_others], both[of_others] = flat, np.fromiter(chain.from_iterable(others), np.uint32, int(of_others.sum()))
            flat = both
        return Ids(flat, np.concatenate([[0], np.cumsum(lengths)]))

    def _spelled(self, parts: pa.Array) -> Ids:
        """Ids of simple pre-tokens by one call of the tokenizer."""
        if not len(parts):
            return Ids(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        data = "\0".join(parts.to_pylist()).encode()
        row = self.spelling[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.spelled.encode_batch_fast([row], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.nonzero(ids == self.mark)[0]
        return Ids(np.delete(ids, marks), np.concatenate([[0], marks - np.arange(len(marks)), [len(ids) - len(marks)]]))

    def encode(self, texts: pa.Array, last: int | None = None) -> Ids:
        """Ids of each text, with ``last`` after each if given."""
        pieces = pc.split_pattern(texts, " ")
        flat = pieces.flatten()
        starts = pieces.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = starts - starts[0]
        coded = flat.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        # A text whose spaces are not all single and inside it is encoded whole; so is one with an empty first piece.
        hollow = (pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0) | _spaced(distinct)[codes]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(starts, np.nonzero(hollow)[0], side="right") - 1] = True
        counts = np.diff(starts)
        opening = np.zeros(len(codes), bool)
        opening[starts[:-1][counts > 0]] = True
        # The same piece differs at the start of a text: nothing stands before it.
        codes = codes.astype(np.int64) * 2 + (0 if self.word_ends else opening)
        kept_codes = codes[~np.repeat(odd, counts)]
        times = np.bincount(kept_codes, minlength=2 * len(distinct))
        # Ids of every code: of pieces after a space, and of those that open a text.
        wanted = np.nonzero(times[0::2])[0]
        pieces = self.pieces_held.ids(distinct.take(pa.array(wanted)), self._pieces)
        first = np.nonzero(times[1::2])[0]
        heads = [self.piece(piece) for piece in distinct.take(pa.array(first)).to_pylist()]
        of_heads = np.fromiter(map(len, heads), np.int64, len(heads))
        lengths, begins = np.zeros(2 * len(distinct), np.int64), np.zeros(2 * len(distinct), np.int64)
        lengths[2 * wanted], begins[2 * wanted] = np.diff(pieces.starts), pieces.starts[:-1]
        lengths[2 * first + 1], begins[2 * first + 1] = of_heads, len(pieces.flat) + np.cumsum(of_heads) - of_heads
        whole = np.concatenate([pieces.flat, np.fromiter(chain.from_iterable(heads), np.uint32, int(of_heads.sum()))])
        codes = kept_codes
        sizes = lengths[codes]
        flat_ids = whole[_ranges(begins[codes], sizes)]
        run = np.concatenate([[0], np.cumsum(sizes)])
        kept = np.cumsum(np.where(odd, 0, counts))
        per_text = np.where(odd, 0, run[kept] - run[kept - np.where(odd, 0, counts)])
        if odd.any() or last is not None:
            tail = [] if last is None else [last]
            out, at = [], 0
            for i, n in enumerate(per_text.tolist()):
                if odd[i]:
                    out.append(np.array(self.whole(texts[i].as_py()) + tail, np.uint32))
                else:
                    out.append(flat_ids[at : at + n])
                    if tail:
                        out.append(np.array(tail, np.uint32))
                    at += n
                per_text[i] = (len(out[-1]) if odd[i] else n + len(tail))
            flat_ids = np.concatenate(out or [np.zeros(0, np.uint32)])
        return Ids(flat_ids, np.concatenate([[0], np.cumsum(per_text)]))

    def whole(self, text: str) -> list[int]:
        """Ids of a text whose spaces need care: cut only where a single space stands between other characters."""
        ids: list[int] = []
        for piece in regex.split(r"(?<=\S)(?= [^\s])", text):
            ids += self.piece(piece)
        return ids


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, in a row."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _spaced(distinct: pa.Array) -> np.ndarray:
    """Pieces that begin or end with white space other than the cut space."""
    return pc.match_substring_regex(distinct, r"^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$").to_numpy(zero_copy_only=False)


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
