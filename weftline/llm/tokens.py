"""Token ids by the tokenizers library, with a memo of the ids of words."""

from __future__ import annotations

import os
import zlib
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .shared import Texts, runs, same_spans

VOCABULARY, END = "byte_bpe_50k.json", 0
#: Words that a worker's memo keeps at most, and words that the library encodes in one call.
MEMO, AT_ONCE = 400_000, 4096

_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
_ODD = np.zeros(256, bool)  # other ASCII white space
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
#: UTF-8 of white space beyond ASCII.
_WIDE = [chr(c).encode() for c in range(0x80, 0x110000) if chr(c).isspace()]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them; strings of added tokens in a text get their ids.

    The vocabulary's pre-tokenizer never joins characters over a single space or line feed between two other
    characters: a space starts the next piece and a line feed is a piece of its own; nor does it join a letter or
    digit and a following stop or comma. So texts are cut there, each distinct word goes through the library once, and
    its ids are looked up from then on, by 64 bits of hash; that the word's bytes are those that were learned is
    checked at each look-up. Texts with other white space, or two of it side by side, with the string of an added token
    (such as <|endoftext|>) or with a word whose hash belongs to another one go through the library whole.
    """

    def __init__(self, path: str | None = None, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words that were seen before don't come here
        self.letters = _byte_letters()
        self.most = memo
        self.stop, self.comma, self.feed = (self._whole(x) for x in (".", ",", "\n"))
        self._forget()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self):
        self.number: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        # the learned words themselves, with the space before them if any: those above eight bytes side by side
        self.sizes, self.places, self.spelled = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), bytearray()
        self.used = self.missed = self.kept = 0

    def _trim(self):
        """Words beyond the memo's size are forgotten after their call; many of them over time renew the whole memo."""
        extra = len(self.number) - max(self.kept, self.most)
        if extra > 0:
            for _ in range(extra):
                self.number.popitem()
            self.used = int(self.starts[len(self.number)])
            del self.spelled[int(self.places[len(self.number)]) :]
            self.missed += extra
        self.kept = len(self.number)
        if self.missed > 16 * self.most:
            self._forget()

    def _learn(self, keys: list[int], raw: list[bytes]):
        """Words of letters only, after a space or not, are one piece, so the model alone is asked; others go through the whole library."""
        words = [w.decode() for w in raw]
        letters = [w.removeprefix(" ").isalpha() for w in words]
        mapped = iter([w.encode().decode("latin-1").translate(self.letters) for w, plain in zip(words, letters, strict=True) if plain])
        other = [w for w, plain in zip(words, letters, strict=True) if not plain]
        found_other = iter([e.ids for i in range(0, len(other), AT_ONCE) for e in self.tokenizer.encode_batch_fast(other[i : i + AT_ONCE], add_special_tokens=False)])
        tokenize = self.model.tokenize
        ids = [[t.id for t in tokenize(next(mapped))] if plain else next(found_other) for plain in letters]
        n, first = len(ids), len(self.number)
        lengths = np.fromiter(map(len, ids), np.int64, n)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        while first + n > len(self.starts):
            self.starts, self.lengths, self.sizes, self.places = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.sizes, self.places))
        sizes = np.fromiter(map(len, raw), np.int64, n)
        kept = np.where(sizes > 8, sizes, 0)
        self.sizes[first : first + n] = sizes
        self.places[first : first + n] = len(self.spelled) + np.cumsum(kept) - kept
        self.spelled += b"".join(w for w in raw if len(w) > 8)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.number.update(zip(keys, range(first, first + n), strict=True))

    def _odd(self, texts: Texts) -> np.ndarray:
        """Texts that can't be cut safely."""
        data = texts.bytes
        space = _SPACE[data]
        bad = _ODD[data]
        leads = set(np.flatnonzero(np.bincount(data, minlength=256)).tolist())
        bad[1:] |= space[1:] & space[:-1]
        for mark in _WIDE:
            if mark[0] in leads:
                at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
                for j in range(1, len(mark)):
                    at = at[data[at + j] == mark[j]]
                bad[at] = True
        filled = np.flatnonzero(np.diff(texts.bounds) > 0)
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                bad[at] = True
                at = raw.find(token, at + 1)
        out = texts.sums(bad) > 0
        out[filled] |= space[texts.bounds[filled]] | space[texts.bounds[filled + 1] - 1]
        return out

    def encode_many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all whole texts of a string column, one after another, and how many each has. Nulls have none."""
        texts = Texts(column)
        data = texts.bytes
        starts, ends, first = texts.words()
        of_word = np.repeat(np.arange(texts.n), np.diff(first))
        odd = self._odd(texts)
        if odd.any():
            fine = ~odd[of_word]
            starts, ends, of_word = starts[fine], ends[fine], of_word[fine]
        inner = starts > texts.bounds[of_word]
        before = data[starts - inner]
        spaced, fed = inner & (before == 32), inner & (before == 10)
        last, prior = data[ends - 1], data[np.maximum(ends - 2, 0)]
        lead = data[np.maximum(ends - 3, 0)]
        ended = ((last == 46) | (last == 44)) & (((ends - starts > 1) & _LETTER[prior]) | ((ends - starts > 2) & (lead == 0xC3) & (prior >= 0x80) & (prior != 0x97) & (prior != 0xB7)))
        low = starts - spaced  # a word takes the space before it along
        size = ends - ended - low
        key = texts.hashes(low, low + size)
        # each distinct hash with any of its words; one pass over the memo
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        sample, index = order[fresh], np.empty(len(key), np.int64)
        index[order] = np.cumsum(fresh) - 1
        keys = ranked[fresh].tolist()
        number = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            raw = data.tobytes()
            at = sample[missing]
            number[missing] = len(self.number) + np.arange(len(missing))
            self._learn([keys[i] for i in missing.tolist()], [raw[a : a + n] for a, n in zip(low[at].tolist(), size[at].tolist(), strict=True)])
        # hashes of spans up to eight bytes are one to one for each size, so longer ones alone are compared
        other = self.sizes[number][index] != size
        long = np.flatnonzero((size > 8) & ~other)
        if len(long):
            spelled = Texts.of(bytes(self.spelled))
            other[long] = ~same_spans(texts, low[long], spelled, self.places[number][index[long]], size[long])
        if other.any():
            odd[of_word[other]] = True
        # three runs of ids to a word: the line feed before it, the word, the mark after it
        marks = np.array(self.feed + self.stop + self.comma, np.uint32)
        ids = np.concatenate([marks, self.ids[: self.used]])
        begin, many = np.empty((len(starts), 3), np.int64), np.empty((len(starts), 3), np.int64)
        begin[:, 0], many[:, 0] = 0, fed
        begin[:, 1], many[:, 1] = self.starts[number][index] + 3, self.lengths[number][index]
        begin[:, 2], many[:, 2] = 1 + (last == 44), ended
        flat = ids[runs(begin.reshape(-1), many.reshape(-1))]
        counts = np.bincount(of_word, weights=many.sum(axis=1), minlength=texts.n).astype(np.int64)
        self._trim()
        if odd.any():
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.array(self._whole(column[int(i)].as_py()), np.uint32)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, counts

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many(pa.array([text]))[0]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False))


_ENCODERS: dict = {}


def encoder(path: str | None = None) -> Encoder:
    """This Python worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
