"""Token ids of whole texts by a public tokenizer file, which stays where it is.

The tokenizer works piece by piece between ASCII white space when its pre-tokenizer drops white space and its
normalisation puts letters in lower case, as that of word_bpe_49k.json does: normalisation, splitting and merging never
look across white space. So each distinct piece is encoded once and remembered by every Python worker, in a table of
bounded size that forgets pieces which did not come again, and the ids of a batch of texts are gathered by numpy. A piece is found by a 64-bit hash and its bytes are
compared; pieces of more than LONGEST bytes, and any whose hash is another's, are encoded each time they come. Pieces of
Latin letters with some marks behind them, which normalisation only puts in lower case, go to the library's merge model
directly, others through the whole tokenizer. A task compares its first texts, and the model's ids of its first pieces,
with what the library gives, and encodes whole texts if they differ. What is remembered changes the time only.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from exactdiff.llm.words import LOWER, SPACED, buffers, hashed

#: Pieces that a worker remembers, some 60 bytes each; beyond that it keeps those that came again since it last forgot some,
#: or none if these are more than KEPT.
REMEMBERED = 500_000
KEPT = 400_000
#: Words that are looked up together; so many new pieces at most come between two looks at REMEMBERED.
_TOGETHER = 1 << 16
#: Pieces that are moved together when some are forgotten.
_MOVED = 1 << 14
_SLOTS = 20
LONGEST = 256
#: Masks of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_CHECKED = 3
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%$#&*|]*)")
#: The characters by which byte-level models write the bytes: printable ones stand for themselves, others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run behind the other."""
    last = np.cumsum(size)
    return np.repeat(begin - (last - size), size) + np.arange(last[-1] if len(last) else 0)


def _heads(low: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each run as a number, zeros behind a shorter run; low has eight bytes behind the last run."""
    return np.ndarray(len(low) - 7, "<u8", low, strides=(1,))[begin] & _FIRST[np.minimum(size, 8)]


class _Pool:
    """Runs of numbers, one behind the other, in an array that grows."""

    def __init__(self, kind: type) -> None:
        self.items, self.used = np.zeros(1 << 16, kind), 0

    def add(self, items: np.ndarray) -> int:
        if self.used + len(items) > len(self.items):
            more = np.zeros(len(self.items) + len(self.items) // 2 + len(items), self.items.dtype)  # no memory where nothing is written
            more[: self.used] = self.items[: self.used]
            self.items = more
        self.items[self.used : self.used + len(items)] = items
        self.used += len(items)
        return self.used - len(items)


class _Pieces:
    """An open-addressing table from hashes to pieces: their bytes, in lower case, and their ids."""

    def __init__(self) -> None:
        self.hash = np.zeros(1 << _SLOTS, np.uint64)
        self.number = np.zeros(1 << _SLOTS, np.int32)
        self.ids, self.bytes, self.heads, self.known = _Pool(np.uint32), _Pool(np.uint8), _Pool(np.uint64), 0
        # of each piece: where its ids begin, how many it has, and the same of its bytes
        self.at = [_Pool(np.int32) for _ in range(4)]
        self.hashes, self.again = _Pool(np.uint64), _Pool(np.bool_)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes (none is 0), or -1."""
        out = np.full(len(h), -1, np.int64)
        slot, rest = (h >> np.uint64(64 - _SLOTS)).astype(np.int64), np.arange(len(h))
        while len(rest):
            there = self.hash[slot]
            hit = there == h[rest]
            out[rest[hit]] = self.number[slot[hit]]
            on = ~hit & (there != 0)
            rest, slot = rest[on], (slot[on] + 1) & (1 << _SLOTS) - 1
        return out

    def put(self, h: np.ndarray, found: list[list[int]], low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Adds different hashes, none of them known, with their ids and their bytes in low."""
        size = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        self._put(h, ids, size, low[_gather(begin, end - begin)], end - begin, _heads(low, begin, end - begin))

    def _put(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray, raw: np.ndarray, length: np.ndarray, heads: np.ndarray) -> None:
        first, first_byte = self.ids.add(ids), self.bytes.add(raw)
        for pool, x in zip([*self.at, self.heads, self.hashes, self.again], (first + np.cumsum(size) - size, size, first_byte + np.cumsum(length) - length, length, heads, h, np.zeros(len(h), np.bool_))):
            pool.add(x)
        number = self.known + np.arange(len(h), dtype=np.int32)
        self.known += len(h)
        slot, rest = (h >> np.uint64(64 - _SLOTS)).astype(np.int64), np.arange(len(h))
        while len(rest):
            _, first = np.unique(slot, return_index=True)
            first = first[self.hash[slot[first]] == 0]
            self.hash[slot[first]], self.number[slot[first]] = h[rest[first]], number[rest[first]]
            left = np.ones(len(rest), bool)
            left[first] = False
            rest, slot = rest[left], (slot[left] + 1) & (1 << _SLOTS) - 1

    def forget(self) -> None:
        """Leaves those that came again, or none if these are too many. They are taken out some at a time, since the places of
        their bytes are many times as large as these, and put back when the old table is gone."""
        k, parts = np.flatnonzero(self.again.items[: self.known]), []
        for lo in range(0, len(k) if len(k) <= KEPT else 0, _MOVED):
            some = k[lo : lo + _MOVED]
            at, size, at_byte, length = (x.items[some] for x in self.at)
            parts.append((self.hashes.items[some], self.ids.items[_gather(at, size)], size, self.bytes.items[_gather(at_byte, length)], length, self.heads.items[some]))
        self.__init__()
        for part in parts:
            self._put(*part)

    def same(self, number: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether pieces have the bytes of low from begin to end: eight at once, and the rest of those that are longer."""
        size = self.at[3].items[number]
        out = (size == end - begin) & (self.heads.items[number] == _heads(low, begin, end - begin))
        k = np.flatnonzero(out & (size > 8))
        if len(k):
            rest = size[k] - 8
            equal = self.bytes.items[_gather(self.at[2].items[number[k]] + 8, rest)] == low[_gather(begin[k] + 8, rest)]
            out[k] = np.logical_and.reduceat(equal, np.cumsum(rest) - rest)
        return out


_library: dict[str, object] = {}
_pieces: dict[str, _Pieces] = {}


class Encoder:
    """Ids of texts and, behind each text's, the end id, as 32-bit integers."""

    def __init__(self, path: str, end: int) -> None:
        if path not in _library:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            _library[path], _pieces[path] = Tokenizer.from_file(path), _Pieces()
        self.path, self.library, self.model = path, _library[path], _library[path].model
        self.end = np.uint32(end)
        lowers = self.library.normalizer is not None and self.library.normalizer.normalize_str("AZ") == "az"
        self.by_piece, self.by_model, self.checks = lowers, True, 0

    def whole(self, text: str) -> np.ndarray:
        return np.array([*self.library.encode(text, add_special_tokens=False).ids, self.end], np.uint32)

    def _by_model(self, letters: str) -> list[int]:
        letters = letters.lower()
        return [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE))]

    def _learn(self, pieces: list[str]) -> list[list[int]]:
        parts = [_PLAIN.fullmatch(p) for p in pieces]
        marks = list(dict.fromkeys(m[2] for m in parts if m))
        ids_of = lambda some: [x.ids for x in self.library.encode_batch(some, add_special_tokens=False)]
        behind = dict(zip(marks, ids_of(marks)))
        if self.checks == 0:
            some = [m for m in parts if m][:300]
            self.by_model = ids_of([m[0] for m in some]) == [self._by_model(m[1]) + behind[m[2]] for m in some]
        if not self.by_model:
            parts = [None] * len(pieces)
        rest = iter(ids_of([p for p, m in zip(pieces, parts) if not m]))
        return [self._by_model(m[1]) + behind[m[2]] if m else next(rest) for m in parts]

    def _ids(self, raw: np.ndarray, low: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one behind the other, and how many each has; low: raw in lower case and eight more bytes."""
        known = _pieces[self.path]
        short = end - begin <= LONGEST
        number = known.find(h)
        known.again.items[number[number >= 0]] = True
        missing = np.flatnonzero((number < 0) & short)
        if len(missing):
            if known.known > REMEMBERED:
                known.forget()
                missing = np.flatnonzero((known.find(h) < 0) & short)
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            for lo in range(0, len(new), 5_000):
                some = first[lo : lo + 5_000]
                size = end[some] - begin[some]
                texts = np.insert(low[_gather(begin[some], size)], np.cumsum(size), 10).tobytes().decode().split("\n")[:-1]  # no piece has a line break
                known.put(new[lo : lo + 5_000], self._learn(texts), low, begin[some], end[some])
            number = known.find(h)
        ok = (number >= 0) & short
        ok[ok] = known.same(number[ok], low, begin[ok], end[ok])
        at, size, pool = known.at[0].items[number], known.at[1].items[number], known.ids.items
        odd = np.flatnonzero(~ok)
        if len(odd):
            found = [x.ids for x in self.library.encode_batch([raw[a:b].tobytes().decode() for a, b in zip(begin[odd].tolist(), end[odd].tolist())], add_special_tokens=False)]
            size[odd] = [len(x) for x in found]
            at[odd] = known.ids.used + np.cumsum(size[odd]) - size[odd]
            pool = np.concatenate((pool[: known.ids.used], np.fromiter(chain.from_iterable(found), np.uint32, int(size[odd].sum()))))
        return pool[_gather(at, size)], size

    def _pieces_of(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        h, row, begin, end = hashed(raw, at, SPACED)
        h = np.maximum(h, np.uint64(1))
        low = np.concatenate((LOWER[raw], np.zeros(8, np.uint8)))
        parts = [self._ids(raw, low, *(x[lo : lo + _TOGETHER] for x in (h, begin, end))) for lo in range(0, len(h), _TOGETHER)]
        ids, size = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        words = np.searchsorted(row, np.arange(1, len(at)))
        ends = np.concatenate(([0], np.cumsum(size)))[words]
        return np.split(np.insert(ids, ends, self.end), (ends + np.arange(1, len(at)))[:-1])

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column; null texts are empty."""
        if not len(column):
            return []
        if self.by_piece:
            out = self._pieces_of(*buffers(column))
            for i, text in enumerate(column):
                if self.checks >= _CHECKED:
                    return out
                if text.as_py():
                    self.checks += 1
                    if not np.array_equal(out[i], self.whole(text.as_py())):
                        self.by_piece = False
                        break
            else:
                return out
        return [self.whole(x.as_py() or "") for x in column]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]
